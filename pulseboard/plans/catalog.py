"""Registered report runs over the driver's test tables.

The parameters are those of FIXTURES.md ("Parameters for the oracle runs").
Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables; ``duck_oracle`` holds the DuckDB SQL twin of each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from pulseboard.params import ActivityGroups, Bands, Cohort, Family, InternalRule, ProductSpec, Targets, TrialSpec
from pulseboard.plans import errors, licences, risk, trials, usage
from pulseboard.sources.bindings import ACTIVITY_PREFIXES, Domain, domain_from_testdata

EVENT_TYPES = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")


def codes(prefixes=ACTIVITY_PREFIXES, types=EVENT_TYPES) -> list[str]:
    return [f"{p}_{t}" for p in prefixes for t in types]


@dataclass(frozen=True)
class FixtureParams:
    """Parameters of the registered runs (FIXTURES.md)."""

    internal: InternalRule = InternalRule(pattern="%7", exempt_org=1)
    internal_strict: InternalRule = InternalRule(pattern="%7%", exempt_org=None)
    targets: Targets = field(
        default_factory=lambda: Targets({"cs": "BCS_CLICK", "vr": "VR_VIEW", "dq": "GRABBER_PURCHASE"})
    )
    errors: tuple[str, ...] = tuple(codes(types=("ERROR",)))
    error_type: str = "VR_ERROR"
    trial: TrialSpec = TrialSpec(type_id=1, type_name="URGENT")
    capped_type_id: int = 2
    r3_activities: tuple[str, ...] = tuple(codes(prefixes=("VR",)))
    relevant: tuple[str, ...] = tuple(codes(prefixes=("BCS", "GRABBER", "EXPORT", "VR")))
    excluded_activities: tuple[str, ...] = tuple(codes(types=("CLICK",)))
    grabber_group: tuple[str, ...] = tuple(codes(prefixes=("GRABBER",)))
    cohort: Cohort = Cohort(lookback_days=30, silent_days=3, min_events=8)
    bands: Bands = Bands(high=4.0, medium=2.0)
    families: dict = field(
        default_factory=lambda: {
            "count_vr": Family(prefixes=("URG",)),
            "count_dq": Family(prefixes=("HI",), names=("MEDIUM",)),
            "count_bcs": Family(prefixes=("NOT", "LO")),
            "count_enrichment": Family(names=("HIGH",)),
        }
    )
    products: ProductSpec = ProductSpec()
    groups: ActivityGroups = field(
        default_factory=lambda: ActivityGroups(
            {"cards": ("BCS_CLICK", "BCS_VIEW"), "visits": ("VR_VIEW", "VR_CLICK", "BCS_VIEW")}
        )
    )
    # periods
    r1: tuple[date, date] = (date(2024, 1, 20), date(2024, 2, 3))
    r1_excluded: tuple[int, ...] = (7,)
    whole_days: tuple[date, date] = (date(2024, 1, 20), date(2024, 1, 25))
    r1_midday_end: datetime = datetime(2024, 1, 25, 12, 0, 0)
    r11_early: tuple[date, date] = (date(2024, 1, 8), date(2024, 1, 17))
    one_day: tuple[date, date] = (date(2024, 1, 20), date(2024, 1, 21))
    period: tuple[date, date] = (date(2024, 1, 20), date(2024, 2, 3))
    window: tuple[date, date] = (date(2024, 1, 8), date(2024, 1, 22))
    mix_window: tuple[date, date] = (date(2024, 1, 20), date(2024, 1, 21))
    as_of: date = date(2024, 1, 31)
    licence_window: tuple[date, date] = (date(2001, 10, 25), date(2001, 11, 10))


P = FixtureParams()


def _domain(spark: SparkSession, sf_dir: str) -> Domain:
    """The domain over the test tables, listed anew by every call."""
    return domain_from_testdata(spark, sf_dir)


def _r1(d: Domain) -> DataFrame:
    return usage.daily_active_orgs(d, *P.r1, (), internal=P.internal, targets=P.targets)


def _r1_excl(d: Domain) -> DataFrame:
    return usage.daily_active_orgs(
        d, *P.r1, P.r1_excluded, internal=P.internal, targets=P.targets
    )


def _r1_midday(d: Domain) -> DataFrame:
    """R1 ending at noon: the last day counts only its events up to then."""
    return usage.daily_active_orgs(
        d, P.r1[0], P.r1_midday_end, (), internal=P.internal, targets=P.targets
    )


def _r2_one_day(d: Domain) -> DataFrame:
    """R2 over a one-day period: one current day paired with the day before."""
    return trials.new_trials_vs_previous(d, *P.one_day, (), trial=P.trial)


def _r15_all(d: Domain) -> DataFrame:
    """R15 with no excluded activity (NOT EXISTS over an empty list)."""
    return trials.trial_top_activities(d, *P.window, (), internal=P.internal, trial=P.trial)


def _r8_excluded(d: Domain) -> DataFrame:
    """R8 with an organisation excluded (its rows gone, its days blank if empty)."""
    return errors.error_detail(
        d, *P.period, P.errors, P.r1_excluded, internal=P.internal, meta_key="k"
    )


def _r11_bcs(d: Domain) -> DataFrame:
    """R11 for a second error type."""
    return errors.error_daily_vs_previous(d, *P.period, P.errors, "BCS_ERROR", (), internal=P.internal)


def _r16_window(d: Domain) -> DataFrame:
    """R16 over the two-week window (more organisations, more mixes)."""
    return trials.trial_product_mix(d, *P.window, P.excluded_activities, internal=P.internal, trial=P.trial)


def _r2(d: Domain) -> DataFrame:
    return trials.new_trials_vs_previous(d, *P.period, (), trial=P.trial)


def _r3(d: Domain) -> DataFrame:
    return licences.concurrent_license_exceeded(
        d, *P.window, (), internal=P.internal,
        capped_type_id=P.capped_type_id, activities=P.r3_activities,
    )


def _r4(d: Domain) -> DataFrame:
    return usage.most_active_touchless_orgs(
        d, *P.window, (), internal=P.internal, targets=P.targets
    )


def _r5(d: Domain) -> DataFrame:
    return risk.slipping_away_orgs(
        d, P.as_of, P.grabber_group, (), internal=P.internal, cohort=P.cohort
    )


def _r6(d: Domain) -> DataFrame:
    return licences.daily_assigned_licenses(d, *P.licence_window, families=P.families)


def _r7(d: Domain) -> DataFrame:
    return errors.top_org_per_error(d, *P.window, P.errors, (), internal=P.internal)


def _r8(d: Domain) -> DataFrame:
    return errors.error_detail(
        d, *P.period, P.errors, (), internal=P.internal, meta_key="k"
    )


def _r9(d: Domain) -> DataFrame:
    return errors.error_counts(d, *P.period, P.errors, (), internal=P.internal)


def _r10(d: Domain) -> DataFrame:
    return errors.error_events(
        d, *P.period, P.errors, P.error_type, (), internal=P.internal, meta_key="k"
    )


def _r11(d: Domain) -> DataFrame:
    return errors.error_daily_vs_previous(
        d, *P.period, P.errors, P.error_type, (), internal=P.internal
    )


def _r11_early(d: Domain) -> DataFrame:
    """R11 where the first day of the previous period has no events."""
    return errors.error_daily_vs_previous(
        d, *P.r11_early, P.errors, P.error_type, (), internal=P.internal
    )


def _r11_every_day(d: Domain) -> DataFrame:
    """R11 with every day of both periods zero-filled."""
    return errors.error_daily_vs_previous(
        d, *P.period, P.errors, P.error_type, (), internal=P.internal, every_day=True
    )


def _r9_groups(d: Domain) -> DataFrame:
    """R9 over an activity list made of named groups."""
    return errors.error_counts(d, *P.period, P.groups.codes("cards", "visits"), (), internal=P.internal)


def _r12(d: Domain) -> DataFrame:
    return trials.trial_product_by_day(
        d, *P.window, P.relevant, internal=P.internal_strict, trial=P.trial
    )


def _r13(d: Domain) -> DataFrame:
    return trials.trial_activity_by_day(
        d, *P.window, P.relevant, internal=P.internal_strict, trial=P.trial
    )


def _r14(d: Domain) -> DataFrame:
    return trials.trial_activity_by_product(
        d, *P.window, P.excluded_activities, internal=P.internal, trial=P.trial
    )


def _r15(d: Domain) -> DataFrame:
    return trials.trial_top_activities(
        d, *P.window, P.excluded_activities, internal=P.internal, trial=P.trial
    )


def _r16(d: Domain) -> DataFrame:
    return trials.trial_product_mix(
        d, *P.mix_window, P.excluded_activities, internal=P.internal, trial=P.trial
    )


def _r17(d: Domain) -> DataFrame:
    return risk.slip_severity(_r5(d), P.bands)


REPORTS_ON_DOMAIN: dict[str, Callable[[Domain], DataFrame]] = {
    "daily_active_orgs": _r1,
    "daily_active_orgs_excluded": _r1_excl,
    "new_trials_vs_previous": _r2,
    "concurrent_license_exceeded": _r3,
    "most_active_touchless_orgs": _r4,
    "slipping_away_orgs": _r5,
    "daily_assigned_licenses": _r6,
    "top_org_per_error": _r7,
    "error_detail": _r8,
    "error_counts": _r9,
    "error_events": _r10,
    "error_daily_vs_previous": _r11,
    "trial_product_by_day": _r12,
    "trial_activity_by_day": _r13,
    "trial_activity_by_product": _r14,
    "trial_top_activities": _r15,
    "trial_product_mix": _r16,
    "slip_severity": _r17,
    "daily_active_orgs_midday_end": _r1_midday,
    "new_trials_one_day": _r2_one_day,
    "trial_top_activities_no_exclusions": _r15_all,
    "error_detail_excluded": _r8_excluded,
    "error_daily_vs_previous_bcs": _r11_bcs,
    "trial_product_mix_window": _r16_window,
    "error_daily_vs_previous_first_day_empty": _r11_early,
    "error_daily_vs_previous_every_day": _r11_every_day,
    "error_counts_of_groups": _r9_groups,
}


# the headline runs timed by bench.py: one per report (R1 with and without
# an exclusion list); the other entries are edge-parameter variants
VARIANTS = (
    "daily_active_orgs_midday_end",
    "new_trials_one_day",
    "trial_top_activities_no_exclusions",
    "error_detail_excluded",
    "error_daily_vs_previous_bcs",
    "trial_product_mix_window",
    "error_daily_vs_previous_first_day_empty",
    "error_daily_vs_previous_every_day",
    "error_counts_of_groups",
)
HEADLINE = [n for n in REPORTS_ON_DOMAIN if n not in VARIANTS]


def _on_testdata(build: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(_domain(spark, sf_dir))

    run.__name__ = build.__name__
    return run


REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _on_testdata(build) for name, build in REPORTS_ON_DOMAIN.items()
}
