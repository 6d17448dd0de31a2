"""Report parameters and the domain's fixed values.

Dates and times are parameters, not data: they are turned into literals on
the driver and folded by Catalyst, so filters on them reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta, timezone

# ---------------------------------------------------------------------------
# Fixed values of the product domain (defaults; every report takes them as
# parameters). They must equal the dashboard's own codes to give its results.
#   target activities:   cards scan  BCS_CARDS_SCAN_PROCESS
#                        visit report VR_REPORT_START
#                        CRM export   GRABBER_EXPORT_CRM
#   product prefixes:    BCS, GRABBER, EXPORT, VR  (anything else -> OTHER)
#   trial subscription:  type id 16, type name FREE_TRIAL
#   capped subscription: type id 32
#   licence families:    visit    name LIKE 'VISIT%'
#                        quality  name LIKE 'GRABBER%' OR name = 'DATA_QUALITY'
#                        cards    name LIKE 'BUSINESS%' OR name LIKE 'CARD%'
#                        enrich   name = 'DATA_ENRICHMENT'
#   slipping-away cohort: look back 120 days, silent for 30 days,
#                         more than 50 events
#   trial length:        14 days
#   severity bands:      >= 10 high, >= 5 medium, else low
#   billing JSON key:    HubSpotID;  billing id prefix length: 24
# ---------------------------------------------------------------------------
TARGET_ACTIVITIES = {
    "cs": "BCS_CARDS_SCAN_PROCESS",
    "vr": "VR_REPORT_START",
    "dq": "GRABBER_EXPORT_CRM",
}
PRODUCT_LIST = ("BCS", "GRABBER", "EXPORT", "VR")
OTHER_PRODUCT = "OTHER"
TRIAL_TYPE_ID = 16
TRIAL_TYPE_NAME = "FREE_TRIAL"
CAPPED_TYPE_ID = 32
COHORT_LOOKBACK_DAYS = 120
COHORT_SILENT_DAYS = 30
COHORT_MIN_EVENTS = 50
TRIAL_DAYS = 14
BAND_HIGH = 10.0
BAND_MEDIUM = 5.0
CRM_ID_JSON_KEY = "HubSpotID"
BILLING_ID_LENGTH = 24


@dataclass(frozen=True)
class Family:
    """A licence family: subscription names matching any prefix or exact name."""

    prefixes: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


LICENCE_FAMILIES = {
    "count_vr": Family(prefixes=("VISIT",)),
    "count_dq": Family(prefixes=("GRABBER",), names=("DATA_QUALITY",)),
    "count_bcs": Family(prefixes=("BUSINESS", "CARD")),
    "count_enrichment": Family(names=("DATA_ENRICHMENT",)),
}


@dataclass(frozen=True)
class InternalRule:
    """Which accounts count as internal, by a SQL LIKE pattern on the username.

    A row is kept when its organisation is ``exempt_org`` or its username does
    NOT match ``pattern``. Three-valued logic as in SQL: an unknown username
    outside the exempt organisation is dropped.
    """

    pattern: str
    exempt_org: int | None = None


@dataclass(frozen=True)
class Bands:
    high: float = BAND_HIGH
    medium: float = BAND_MEDIUM


@dataclass(frozen=True)
class Cohort:
    lookback_days: int = COHORT_LOOKBACK_DAYS
    silent_days: int = COHORT_SILENT_DAYS
    min_events: int = COHORT_MIN_EVENTS


@dataclass(frozen=True)
class ProductSpec:
    products: tuple[str, ...] = PRODUCT_LIST
    other: str = OTHER_PRODUCT


@dataclass(frozen=True)
class TrialSpec:
    type_id: int = TRIAL_TYPE_ID
    type_name: str = TRIAL_TYPE_NAME
    days: int = TRIAL_DAYS


@dataclass(frozen=True)
class Targets:
    """Named target activities (output column stem -> activity code)."""

    codes: dict[str, str] = field(default_factory=lambda: dict(TARGET_ACTIVITIES))


def as_datetime(value: date | datetime | str) -> datetime:
    """Parse a report bound the way an ISO date picker value is parsed.

    A bare date means midnight of that day; a value with an offset becomes
    UTC wall-clock time.
    """
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        return datetime.combine(value, time())
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def is_midnight(value: datetime) -> bool:
    return value.time() == time()


@dataclass(frozen=True)
class PeriodPair:
    """Current period ``(start, end]`` and the previous one of equal length.

    ``n_days`` = whole days between the two bounds. The previous period's
    first day is ``start - (n_days - 1)`` (the series the dashboard queries
    then holds ``2 * n_days`` days); the current days ``start+1 .. end`` pair
    with the days ``n_days`` earlier.
    """

    start: datetime
    end: datetime

    @property
    def n_days(self) -> int:
        return (self.end.date() - self.start.date()).days

    @property
    def series_start(self) -> date:
        return (self.start - timedelta(days=self.n_days - 1)).date()

    @property
    def first_current_day(self) -> date:
        return self.start.date() + timedelta(days=1)

    @property
    def last_day(self) -> date:
        return self.end.date()

    @classmethod
    def of(cls, start, end) -> "PeriodPair":
        return cls(as_datetime(start), as_datetime(end))


@dataclass(frozen=True)
class ActivityGroups:
    """Named activity groups (group name -> activity codes).

    ``codes(*names)`` concatenates groups in the order given, without
    repeating a code - the list a report takes as its activity parameter.
    """

    groups: dict[str, tuple[str, ...]]

    def codes(self, *names: str) -> list[str]:
        out: list[str] = []
        for name in names:
            for code in self.groups[name]:
                if code not in out:
                    out.append(code)
        return out

    @classmethod
    def parse(cls, items: list[str]) -> "ActivityGroups":
        """Groups given as ``name=CODE+CODE`` texts."""
        parts = (item.split("=", 1) for item in items)
        return cls({name: tuple(codes.split("+")) for name, codes in parts})

