"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from pulseboard.functions.ids import org_external_ids, org_external_ids_weighted
from pulseboard.functions.predicates import (
    is_false,
    is_true,
    keep_external,
    matches_family,
    not_excluded,
    not_in_list_keep_null,
)
from pulseboard.functions.text import band, fold_other, product_of
from pulseboard.functions.time import (
    date_lit,
    day_of,
    format_utc,
    ts_lit,
    within_days,
)

__all__ = [
    "band",
    "date_lit",
    "day_of",
    "fold_other",
    "format_utc",
    "is_false",
    "is_true",
    "keep_external",
    "matches_family",
    "not_excluded",
    "not_in_list_keep_null",
    "org_external_ids",
    "org_external_ids_weighted",
    "product_of",
    "ts_lit",
    "within_days",
]
