"""Run a report from the command line.

    python -m pulseboard daily_active_orgs --warehouse /data/usage \\
        --start 2024-01-01 --end 2024-01-31 --exclude 1 \\
        --internal-pattern '%@corp.example' --exempt-org 1 --out /data/out/r1 --format parquet

``--warehouse`` reads domain tables written by ``write_domain``;
``--testdata`` reads the driver's test tables through the bindings. The
result is written with Spark's DataFrame writer (``--out``); with ``--show N``
instead, the first N rows are printed, and the output says so.

``--counts`` names the fact's stored daily roll-up: reports merge its days and
read the fact only for part days. ``write_counts`` writes it, or with ``--start``
and ``--end`` writes those days again:

    python -m pulseboard write_counts --warehouse /data/usage --counts /data/usage_counts --start 2024-01-30 --end 2024-01-31

``--sets`` names the daily bitmaps of organisations that ``write_sets`` writes (for
the target activities and the internal rule given then); ``active_orgs_of_days``
and ``active_orgs_of_window`` read nothing else.

Activity lists are given as codes (``--activities A,B``) or as named groups
(``--group cards=A+B --group visits=C --use-groups cards,visits``).
"""

from __future__ import annotations

import argparse
import sys
from datetime import timedelta
from functools import partial

from pulseboard.params import (
    CAPPED_TYPE_ID,
    LICENCE_FAMILIES,
    PRODUCT_LIST,
    ActivityGroups,
    Bands,
    Cohort,
    Family,
    InternalRule,
    ProductSpec,
    Targets,
    TrialSpec,
    as_datetime,
)
from pulseboard.plans.errors import META_KEY
from pulseboard.plans import errors, licences, risk, trials, usage
from pulseboard.sources.bindings import domain_from_parquet, domain_from_testdata
from pulseboard.sources.daily import read_activity_counts, read_daily_distinct, write_activity_counts, write_daily_distinct

PERIOD = {
    "daily_active_orgs": usage.daily_active_orgs,
    "most_active_touchless_orgs": usage.most_active_touchless_orgs,
    "new_trials_vs_previous": trials.new_trials_vs_previous,
    "concurrent_license_exceeded": licences.concurrent_license_exceeded,
    "daily_assigned_licenses": licences.daily_assigned_licenses,
    "top_org_per_error": errors.top_org_per_error,
    "error_detail": errors.error_detail,
    "error_counts": errors.error_counts,
    "error_events": errors.error_events,
    "error_daily_vs_previous": errors.error_daily_vs_previous,
    "trial_product_by_day": trials.trial_product_by_day,
    "trial_activity_by_day": trials.trial_activity_by_day,
    "trial_activity_by_product": trials.trial_activity_by_product,
    "trial_top_activities": trials.trial_top_activities,
    "trial_product_mix": trials.trial_product_mix,
}
AS_OF = {"slipping_away_orgs", "slip_severity"}
# reports whose activity list has no default: leaving it out would give no rows
NEED_ACTIVITIES = AS_OF | {
    "top_org_per_error", "error_detail", "error_counts", "error_events", "error_daily_vs_previous",
    "trial_product_by_day", "trial_activity_by_day",
}
REPORT_NAMES = sorted([*PERIOD, *AS_OF])
WRITE_COUNTS, WRITE_SETS = "write_counts", "write_sets"
OF_SETS = {"active_orgs_of_days": usage.active_orgs_of_days, "active_orgs_of_window": usage.active_orgs_of_window}


def _csv(text: str | None) -> list[str]:
    return [t for t in (text or "").split(",") if t]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulseboard", description="Run one product-usage report.")
    p.add_argument("report", choices=[*REPORT_NAMES, *OF_SETS, WRITE_COUNTS, WRITE_SETS])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--warehouse", help="root of the domain tables (write_domain layout)")
    src.add_argument("--testdata", help="folder of the driver's test tables")
    p.add_argument("--counts", help="folder of the fact's daily roll-up")
    p.add_argument("--sets", help="folder of the daily bitmaps of organisations")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--as-of")
    p.add_argument("--exclude", default="", help="organisation ids to leave out, comma separated")
    p.add_argument("--internal-pattern", default=None, help="LIKE pattern of internal usernames")
    p.add_argument("--exempt-org", type=int, default=None, help="organisation exempt from the rule")
    p.add_argument("--activities", default="", help="activity codes (group / relevant / errors)")
    p.add_argument("--targets", default="", help="target activities of R1/R4 as stem=CODE, comma separated")
    p.add_argument("--excluded-activities", default="")
    p.add_argument("--error-type", default=None)
    p.add_argument("--trial-type-id", type=int, default=TrialSpec().type_id)
    p.add_argument("--trial-type-name", default=TrialSpec().type_name)
    p.add_argument("--group", action="append", default=[], help="an activity group, name=CODE+CODE (repeat)")
    p.add_argument("--use-groups", default="", help="groups whose codes make the activity list")
    p.add_argument("--exclude-groups", default="", help="groups whose codes make the excluded activities")
    p.add_argument("--lookback-days", type=int, default=Cohort().lookback_days)
    p.add_argument("--silent-days", type=int, default=Cohort().silent_days)
    p.add_argument("--min-events", type=int, default=Cohort().min_events)
    p.add_argument("--band-high", type=float, default=Bands().high)
    p.add_argument("--band-medium", type=float, default=Bands().medium)
    p.add_argument("--capped-type-id", type=int, default=CAPPED_TYPE_ID)
    p.add_argument("--family", action="append", default=[], help="licence family, column=PREFIX%%+NAME (repeat)")
    p.add_argument("--products", default=",".join(PRODUCT_LIST), help="product prefixes")
    p.add_argument("--json-key", default=META_KEY, help="payload key shown as meta")
    p.add_argument("--every-day", action="store_true", help="zero-fill every day of the daily error comparison")
    p.add_argument("--out", help="output path; omit to print the first rows")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--show", type=int, default=20)
    return p


def _activities(args, codes: str, groups: str) -> list[str]:
    """Codes given one by one, then those of the named groups, without repeats."""
    own = ActivityGroups({"": tuple(_csv(codes)), **ActivityGroups.parse(args.group).groups})
    return own.codes("", *_csv(groups))


def _families(items: list[str]) -> dict[str, Family]:
    out = {}
    for column, terms in (item.split("=", 1) for item in items):
        parts = terms.split("+")
        out[column] = Family(
            prefixes=tuple(t[:-1] for t in parts if t.endswith("%")),
            names=tuple(t for t in parts if not t.endswith("%")),
        )
    return out or dict(LICENCE_FAMILIES)


def _rule(args) -> InternalRule | None:
    return InternalRule(pattern=args.internal_pattern, exempt_org=args.exempt_org) if args.internal_pattern else None


def _targets(args) -> Targets:
    return Targets(dict(t.split("=", 1) for t in _csv(args.targets))) if args.targets else Targets()


def build_report(args, domain):
    rule = _rule(args)
    excluded = [int(x) for x in _csv(args.exclude)]
    acts = _activities(args, args.activities, args.use_groups)
    left_out = _activities(args, args.excluded_activities, args.exclude_groups)
    trial = TrialSpec(type_id=args.trial_type_id, type_name=args.trial_type_name)
    products = {"products": ProductSpec(products=tuple(_csv(args.products)))}
    targets = _targets(args)
    name = args.report
    if name in OF_SETS:
        first, last = (as_datetime(x).date() for x in (args.start, args.end))
        return OF_SETS[name](read_daily_distinct(domain.spark, _needed(args, "sets")), first, last, targets=targets)
    if name in NEED_ACTIVITIES and not acts:
        raise ValueError(f"{name} needs --activities or --use-groups")
    if name in AS_OF:
        cohort = Cohort(args.lookback_days, args.silent_days, args.min_events)
        out = risk.slipping_away_orgs(domain, args.as_of, acts, excluded, internal=rule, cohort=cohort)
        return risk.slip_severity(out, Bands(args.band_high, args.band_medium)) if name == "slip_severity" else out
    fn = PERIOD[name]
    period = (args.start, args.end)
    if name == "daily_assigned_licenses":
        return fn(domain, *period, families=_families(args.family))
    if name == "new_trials_vs_previous":
        return fn(domain, *period, excluded, trial=trial)
    if name in ("trial_product_by_day", "trial_activity_by_day"):
        return fn(domain, *period, acts, internal=rule, trial=trial)
    if name in ("trial_activity_by_product", "trial_top_activities", "trial_product_mix"):
        extra = {} if name == "trial_top_activities" else products
        return fn(domain, *period, left_out, internal=rule, trial=trial, **extra)
    if name == "error_events":
        return fn(domain, *period, acts, args.error_type, excluded, internal=rule, meta_key=args.json_key)
    if name == "error_daily_vs_previous":
        return fn(domain, *period, acts, args.error_type, excluded, internal=rule, every_day=args.every_day)
    if name == "error_detail":
        return fn(domain, *period, acts, excluded, internal=rule, meta_key=args.json_key)
    if name in ("top_org_per_error", "error_counts"):
        return fn(domain, *period, acts, excluded, internal=rule)
    if name == "concurrent_license_exceeded":
        extra = {"activities": acts} if acts else {}
        return fn(domain, *period, excluded, internal=rule, capped_type_id=args.capped_type_id, **extra)
    return fn(domain, *period, excluded, internal=rule, targets=targets)


def source(args, spark):
    """The domain that the arguments name, with its stored roll-up if there is one."""
    domain = domain_from_parquet(spark, args.warehouse) if args.warehouse else domain_from_testdata(spark, args.testdata)
    if args.counts and args.report in REPORT_NAMES:
        return domain.replace(activity_counts=partial(read_activity_counts, spark, args.counts))
    return domain


def _needed(args, folder: str) -> str:
    if not getattr(args, folder):
        raise ValueError(f"{args.report} needs --{folder}")
    return getattr(args, folder)


def write_stored(args, domain) -> None:
    """The roll-up or the bitmaps, of all days or of those from ``--start`` to ``--end``."""
    if bool(args.start) != bool(args.end):
        raise ValueError("give both --start and --end, or neither")
    days = None
    if args.start:
        first, last = as_datetime(args.start).date(), as_datetime(args.end).date()
        days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    if args.report == WRITE_COUNTS:
        write_activity_counts(domain, _needed(args, "counts"), days)
    else:
        write_daily_distinct(domain, _needed(args, "sets"), days, activities=_targets(args).codes.values(), internal=_rule(args))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pulseboard.session import build_session

    spark = build_session()
    domain = source(args, spark)
    if args.report in (WRITE_COUNTS, WRITE_SETS):
        write_stored(args, domain)
        return 0
    df = build_report(args, domain)
    if args.out:
        df.write.mode("overwrite").format(args.format).option("header", "true").save(args.out)
    else:
        print(f"The first {args.show} rows at most; --out writes all of them.")
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
