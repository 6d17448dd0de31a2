"""Reusable DataFrame operators the reports are built from."""

from pulseboard.operators.broadcast import bounded_broadcast
from pulseboard.operators.calendar import Series, attach_daily, attach_detail, day_spine
from pulseboard.operators.counts import count_where, distinct_count_by, weighted_count_where
from pulseboard.operators.densify import densify_days
from pulseboard.operators.multiplicity import multiplicity
from pulseboard.operators.period import pair_with_previous
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.operators.topk import top1_per_group

__all__ = [
    "Series",
    "attach_daily",
    "attach_detail",
    "bounded_broadcast",
    "count_where",
    "day_spine",
    "densify_days",
    "distinct_count_by",
    "multiplicity",
    "pair_with_previous",
    "rollup_activity",
    "top1_per_group",
    "weighted_count_where",
    "with_user_rule",
]
