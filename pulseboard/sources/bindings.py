"""The nine domain frames every report reads.

Two ways to get them:

* :func:`domain_from_parquet` / :func:`domain_from_catalog` - a warehouse that
  already stores the domain tables (production; see ``schemas.py``);
* :func:`domain_from_testdata` - the driver's TPC-H-like test tables mapped
  onto the domain (the mapping of FIXTURES.md section 2). The DuckDB oracle
  uses the very same expressions.

All frames are lazy; nothing is read until a report runs an action.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import cache, cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.functions.time import date_lit, ts_lit
from pulseboard.params import CRM_ID_JSON_KEY, as_datetime, is_midnight
from pulseboard.schemas import DOMAIN_SCHEMAS, TEST_SCHEMAS
from pulseboard.sources.tables import read_table, driver_table, warehouse_table

DOMAIN_TABLES = (
    "user_activity",
    "user",
    "organization",
    "org_subscription",
    "subscription_type",
    "user_license",
    "plan_variant",
    "billing_profile",
    "crm_profile",
)

Frame = DataFrame | Callable[[], DataFrame]


class Domain:
    """Domain frames, each made on first use. Keys assumed unique: user.user_id,
    organization.organization_id, org_subscription.org_subscription_id.

    A table is given as a DataFrame or as a function that makes it, so building
    a report reads the listings and schemas of the tables it uses and no others.

    ``activity_day_col`` is the DATE column the activity fact is partitioned by
    (None: not partitioned). ``activity_by_user``: the fact is bucketed by
    user_id, so a semi join on users costs no exchange. ``stored_fact``: the
    fact is stored at full size, so a filter that takes a small job of its own
    is worth it. ``activity_counts`` is the fact's stored daily roll-up (:mod:`pulseboard.sources.daily`), if any.
    """

    def __init__(
        self,
        *,
        activity_day_col: str | None = None,
        activity_by_user: bool = False,
        stored_fact: bool = False,
        activity_counts: Frame | None = None,
        **tables: Frame,
    ) -> None:
        if sorted(tables) != sorted(DOMAIN_TABLES):
            raise TypeError(f"give exactly the tables {', '.join(DOMAIN_TABLES)}")
        self.activity_day_col = activity_day_col
        self.activity_by_user = activity_by_user
        self.stored_fact = stored_fact
        self._given = {**tables, **({} if activity_counts is None else {"activity_counts": activity_counts})}

    def __getattr__(self, name: str) -> DataFrame:
        # Reached only while the frame is not made yet.
        given = self.__dict__.get("_given", {})
        if name not in given:
            raise AttributeError(name)
        frame = given[name]
        self.__dict__[name] = frame if isinstance(frame, DataFrame) else frame()
        return self.__dict__[name]

    @property
    def made(self) -> set[str]:
        """The tables whose frames exist by now."""
        return set(self._given) & set(self.__dict__)

    def replace(self, **changes) -> Domain:
        """The same domain with other tables or layout flags."""
        flags = {"activity_day_col": self.activity_day_col, "activity_by_user": self.activity_by_user, "stored_fact": self.stored_fact}
        return Domain(**{**flags, **self._given, **changes})

    def activity(self, lo=None, hi=None, lo_strict: bool = False) -> DataFrame:
        """The activity fact restricted to ``lo <= created <= hi`` (``>`` when
        ``lo_strict``; either bound optional). On a day-partitioned fact the
        same bounds are added on the partition column, so only the days in
        range are listed and read (partition pruning)."""
        created = F.col("created")
        cond = F.lit(True)
        if lo is not None:
            cond = cond & ((created > ts_lit(lo)) if lo_strict else (created >= ts_lit(lo)))
        if hi is not None:
            cond = cond & (created <= ts_lit(hi))
        if self.activity_day_col:
            day = F.col(self.activity_day_col)
            if lo is not None:
                cond = cond & (day >= date_lit(lo))
            if hi is not None:
                cond = cond & (day <= date_lit(hi))
        return self.user_activity.filter(cond)

    def counted(self, lo=None, hi=None, lo_strict: bool = False) -> DataFrame:
        """The same events as (user_id, organization_id, activity, day, ``n`` events, ``last_at``).

        Without a stored roll-up these are the events themselves, ``n`` = 1.
        With one, whole days of the window come from it, and the fact is read
        only for the part days at the ends.
        """
        if "activity_counts" not in self._given:
            return self._as_counts(self.activity(lo, hi, lo_strict))
        lo, hi = (None if x is None else as_datetime(x) for x in (lo, hi))
        one = timedelta(days=1)
        first = None if lo is None else lo.date() if is_midnight(lo) and not lo_strict else lo.date() + one
        last = None if hi is None else hi.date() - one  # an inclusive bound never covers its own day
        if first is not None and last is not None and first > last:
            return self._as_counts(self.activity(lo, hi, lo_strict))
        whole = F.lit(True)
        parts = []
        if first is not None:
            whole = whole & (F.col("day") >= date_lit(first))
            if lo < as_datetime(first):
                parts.append(self.activity(lo, first, lo_strict).filter(F.col("created") < ts_lit(first)))
        if last is not None:
            whole = whole & (F.col("day") <= date_lit(last))
            parts.append(self.activity(last + one, hi))
        return reduce(DataFrame.unionByName, map(self._as_counts, parts), self.activity_counts.filter(whole))

    @staticmethod
    def _as_counts(events: DataFrame) -> DataFrame:
        created = F.col("created")
        return events.select(
            "user_id", "organization_id", "activity",
            F.to_date(created).alias("day"), F.lit(1).cast("bigint").alias("n"), created.alias("last_at"),
        )

    @property
    def spark(self) -> SparkSession:
        made = [self.__dict__[name] for name in self.made]
        return (made[0] if made else self.user_activity).sparkSession

    # Derived dimension frames, defined once per domain (lazy plans, no data).
    @cached_property
    def org_ext(self) -> DataFrame:
        """Organisation x matching billing/CRM profile rows with resolved ids."""
        from pulseboard.functions.ids import org_external_ids

        return org_external_ids(self.organization, self.billing_profile, self.crm_profile)

    @cached_property
    def org_ext_weighted(self) -> DataFrame:
        """Distinct (organisation, ids) with the profile rows behind each."""
        from pulseboard.functions.ids import org_external_ids_weighted

        return org_external_ids_weighted(self.org_ext)

    @cached_property
    def org_ext_distinct(self) -> DataFrame:
        """Distinct (organisation, name, ids): the group keys of the reports."""
        return self.org_ext.distinct()

    @cached_property
    def org_row_mult(self) -> DataFrame:
        """(organization_id, ext_mult): profile-join fan-out per organisation."""
        from pulseboard.operators.multiplicity import multiplicity

        return multiplicity(self.org_ext, ["organization_id"], "ext_mult")


def domain_from_parquet(
    spark: SparkSession, root: str, activity_day_col: str | None = "event_date", counts_root: str | None = None
) -> Domain:
    """The domain under ``root`` as :func:`pulseboard.sources.warehouse.write_domain`
    published it last; without a published version, ``root/<table>`` Parquet
    datasets (activity fact partitioned by ``activity_day_col``; pass None for
    an unpartitioned one). ``counts_root`` is where the fact's daily roll-up lies."""
    from pulseboard.sources.daily import read_activity_counts
    from pulseboard.sources.versions import current_version

    version = cache(lambda: current_version(spark, root))

    def table(name: str) -> DataFrame:
        schema = DOMAIN_SCHEMAS[name]
        if name == "user_activity" and activity_day_col:
            schema = f"{schema}, {activity_day_col} DATE"
        if version() is not None:
            return version().read(spark, root, name, schema)
        return read_table(spark, warehouse_table(root, name), schema)

    counts = None if counts_root is None else partial(read_activity_counts, spark, counts_root)
    return Domain(
        **{name: partial(table, name) for name in DOMAIN_TABLES},
        activity_day_col=activity_day_col,
        stored_fact=True,
        activity_counts=counts,
    )


def domain_from_jdbc(
    spark: SparkSession,
    url: str,
    tables: dict[str, str],
    properties: dict[str, str] | None = None,
    partitions: dict[str, tuple[str, object, object, int]] | None = None,
) -> Domain:
    """Domain tables read straight from a SQL database over JDBC.

    ``tables`` maps each domain name to a table or subquery ``(SELECT ...) t``
    that returns the domain columns. ``partitions`` maps a domain name to
    ``(column, lower bound, upper bound, number)``: that table is read in so
    many parallel range queries (rows outside the bounds fall into the outer
    ranges). Give it for the fact, users, licences and subscriptions; a table
    left out is one query in one task. Report filters on the fact are pushed
    into the database's WHERE clause by Spark's JDBC source. Spark connects
    once per table a report uses, to read its schema.
    """
    props = dict(properties or {})

    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", tables[name])
        for k, v in props.items():
            reader = reader.option(k, v)
        if name in (partitions or {}):
            column, low, high, n = partitions[name]
            reader = reader.option("partitionColumn", column).option("numPartitions", str(n))
            reader = reader.option("lowerBound", str(low)).option("upperBound", str(high))
        return reader.load()

    return Domain(**{name: partial(table, name) for name in DOMAIN_TABLES})


def domain_from_catalog(
    spark: SparkSession, database: str, activity_day_col: str | None = "event_date"
) -> Domain:
    """Domain tables registered in the session catalog under ``database``
    (e.g. by :func:`pulseboard.sources.warehouse.write_domain_catalog`; their
    bucketing is kept). ``activity_day_col`` names the fact's day partition
    column when it has one."""
    columns = spark.catalog.listColumns(f"{database}.user_activity")
    by_day = activity_day_col if activity_day_col in [c.name for c in columns] else None
    bucketed = "user_id" in [c.name for c in columns if c.isBucket]
    tables = {name: partial(spark.table, f"{database}.{name}") for name in DOMAIN_TABLES}
    return Domain(**tables, activity_day_col=by_day, activity_by_user=bucketed, stored_fact=True)


# ---------------------------------------------------------------------------
# Test-table mapping (FIXTURES.md section 2). Fixed values of the mapping:
#   activity prefix by event_id % 5: 0 BCS, 1 GRABBER, 2 EXPORT, 3 VR, 4 LOGIN
#   subscriptions start 2024-01-01 + (o_orderkey % 30) days, last 60 days,
#   cap o_orderkey % 3 + 1; type id = first char of o_orderpriority,
#   type name = o_orderpriority from its third character
#   organisations: one for every 10 customer keys (id = c_custkey // 10), so
#   they grow with the scale factor; name 'Org <id>'
#   billing ids 'bw-<org>', CRM ids 'hs-<org>'; billing profiles: a supplier
#   per profile, odd keys under 'bx-' (no organisation has such an id); CRM
#   profiles: a customer per profile, keys divisible by 3 under 'hx-'; every
#   17th organisation has no billing id
#   plan flags by id % 5: 0, 1, 2 touchless, 2 enterprise; touchless unknown
#   at id % 7 = 0, enterprise unknown at id % 11 = 0
#   events without a user: event_id % 29 = 0; without an organisation:
#   event_id % 31 = 0; without an activity: event_id % 37 = 0
# ---------------------------------------------------------------------------
ACTIVITY_PREFIXES = ("BCS", "GRABBER", "EXPORT", "VR", "LOGIN")
SUBSCRIPTION_EPOCH = "2024-01-01 00:00:00"
SUBSCRIPTION_SPREAD_DAYS = 30
SUBSCRIPTION_LENGTH_DAYS = 60
CUSTOMERS_PER_ORG = 10


def _org_of(custkey: str) -> F.Column:
    return F.expr(f"CAST({custkey} AS BIGINT) DIV {CUSTOMERS_PER_ORG}")


def _prefix_by_event_id(event_id: str) -> F.Column:
    k = F.col(event_id) % len(ACTIVITY_PREFIXES)
    expr = F.when(k == 0, F.lit(ACTIVITY_PREFIXES[0]))
    for i, p in enumerate(ACTIVITY_PREFIXES[1:], start=1):
        expr = expr.when(k == i, F.lit(p))
    return expr


def activity_from_events(events: DataFrame, customer: DataFrame) -> DataFrame:
    """The activity fact from the test ``events`` and ``customer``:
    organisation = the customer's, some of the users, organisations and
    activities unknown."""
    known = customer.select("c_custkey")
    code = F.concat(_prefix_by_event_id("event_id"), F.lit("_"), F.upper("event_type"))

    def unless(every: int, value: F.Column) -> F.Column:
        return F.when(F.col("event_id") % every != 0, value)

    return events.join(known, events.user_id == known.c_custkey).select(
        F.col("event_id"),
        unless(29, F.col("user_id")).alias("user_id"),
        unless(31, _org_of("user_id")).alias("organization_id"),
        unless(37, code).alias("activity"),
        F.col("ts").alias("created"),
        F.col("props").alias("payload"),
    )


def domain_from_testdata(spark: SparkSession, sf_dir: str) -> Domain:
    @cache
    def read(name: str) -> DataFrame:
        return read_table(spark, driver_table(sf_dir, name), TEST_SCHEMAS[name])

    @cache
    def cust_org() -> DataFrame:
        return read("customer").select("c_custkey", _org_of("c_custkey").alias("cust_org"))

    @cache
    def orgs() -> DataFrame:
        return cust_org().select(F.col("cust_org").alias("organization_id")).distinct()

    org_id = F.col("organization_id")

    def user() -> DataFrame:
        return read("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            _org_of("c_custkey").alias("organization_id"),
            (F.col("c_acctbal") < 0).alias("is_deleted"),
        )

    def organization() -> DataFrame:
        return orgs().select(
            "organization_id",
            F.concat(F.lit("Org "), org_id.cast("string")).alias("name"),
            F.when(org_id % 17 != 0, F.concat(F.lit("bw-"), org_id.cast("string"))).alias("billing_id"),
            F.concat(F.lit("hs-"), org_id.cast("string")).alias("crm_id"),
        )

    def org_subscription() -> DataFrame:
        orders = read("orders")
        epoch = F.lit(SUBSCRIPTION_EPOCH).cast("timestamp_ntz")
        valid_from = epoch + F.make_dt_interval(
            days=(F.col("o_orderkey") % SUBSCRIPTION_SPREAD_DAYS).cast("int")
        )
        return orders.join(cust_org(), orders.o_custkey == cust_org().c_custkey).select(
            F.col("o_orderkey").alias("org_subscription_id"),
            F.col("cust_org").alias("organization_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("subscription_type_id"),
            (F.col("o_orderkey") % 3 + 1).cast("int").alias("max_users"),
            valid_from.alias("valid_from"),
            (valid_from + F.make_dt_interval(days=F.lit(SUBSCRIPTION_LENGTH_DAYS))).alias("valid_until"),
        )

    def subscription_type() -> DataFrame:
        return read("orders").select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("subscription_type_id"),
            F.expr("substring(o_orderpriority, 3)").alias("name"),
        ).distinct()

    def user_license() -> DataFrame:
        lineitem = read("lineitem")
        ord_cust = read("orders").select("o_orderkey", "o_custkey")
        return lineitem.join(ord_cust, lineitem.l_orderkey == ord_cust.o_orderkey).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").alias("org_subscription_id"),
            F.col("l_shipdate").alias("assigned_at"),
            F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("unassigned_at"),
        )

    def plan_variant() -> DataFrame:
        return orgs().select(
            F.concat(F.lit("bw-"), org_id.cast("string")).alias("customer_id"),
            F.when(org_id % 7 != 0, (org_id % 5).isin(0, 1, 2)).alias("touchless"),
            F.when(org_id % 11 != 0, org_id % 5 == 2).alias("enterprise"),
        )

    def billing_profile() -> DataFrame:
        supp = F.col("s_suppkey").cast("string")
        return read("supplier").select(
            F.concat(F.when(F.col("s_suppkey") % 2 == 0, "bw-").otherwise("bx-"), supp).alias("id"),
            F.concat(F.lit('{"' + CRM_ID_JSON_KEY + '": "h'), supp, F.lit('"}')).alias("customfields"),
        )

    def crm_profile() -> DataFrame:
        cust = F.col("c_custkey").cast("string")
        return read("customer").select(
            F.concat(F.when(F.col("c_custkey") % 3 != 0, "hs-").otherwise("hx-"), cust).alias("id"),
            F.concat(F.col("c_name"), F.lit("-"), F.col("c_mktsegment")).alias("billing_customer_id"),
        )

    return Domain(
        user_activity=lambda: activity_from_events(read("events"), read("customer")),
        user=user,
        organization=organization,
        org_subscription=org_subscription,
        subscription_type=subscription_type,
        user_license=user_license,
        plan_variant=plan_variant,
        billing_profile=billing_profile,
        crm_profile=crm_profile,
    )
