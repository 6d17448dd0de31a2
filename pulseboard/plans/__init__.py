"""Report plans (R1-R17), each a lazy DataFrame builder over a Domain."""

from pulseboard.plans.errors import (
    error_counts,
    error_daily_vs_previous,
    error_detail,
    error_events,
    error_rows,
    top_org_per_error,
)
from pulseboard.plans.licences import concurrent_license_exceeded, daily_assigned_licenses
from pulseboard.plans.risk import slip_severity, slipping_away_orgs, slipping_cohort
from pulseboard.plans.trials import (
    new_trials_vs_previous,
    trial_activity_by_day,
    trial_activity_by_product,
    trial_product_by_day,
    trial_product_mix,
    trial_top_activities,
)
from pulseboard.plans.usage import daily_active_orgs, most_active_touchless_orgs

__all__ = [
    "concurrent_license_exceeded",
    "daily_active_orgs",
    "daily_assigned_licenses",
    "error_counts",
    "error_daily_vs_previous",
    "error_detail",
    "error_events",
    "error_rows",
    "most_active_touchless_orgs",
    "new_trials_vs_previous",
    "slip_severity",
    "slipping_away_orgs",
    "slipping_cohort",
    "top_org_per_error",
    "trial_activity_by_day",
    "trial_activity_by_product",
    "trial_product_by_day",
    "trial_product_mix",
    "trial_top_activities",
]
