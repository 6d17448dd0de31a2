"""Row predicates shared by the reports (all built-in expressions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseboard.params import InternalRule


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_external(org: str | Column, username: str | Column, rule: InternalRule | None) -> Column:
    """``org = exempt OR username NOT LIKE pattern`` with SQL null semantics
    (no rule: every row is kept)."""
    if rule is None:
        return F.lit(True)
    not_internal = ~_col(username).like(rule.pattern)
    if rule.exempt_org is None:
        return not_internal
    return (_col(org) == F.lit(rule.exempt_org)) | not_internal


def not_excluded(org: str | Column, excluded: Iterable[int]) -> Column:
    """``org <> ALL(excluded)``: an empty list keeps every row, NULL included;
    a non-empty list drops NULL (unknown) like SQL does."""
    values = list(excluded)
    if not values:
        return F.lit(True)
    return ~_col(org).isin(values)


def not_in_list_keep_null(c: str | Column, values: Iterable[str]) -> Column:
    """``NOT EXISTS (SELECT 1 FROM unnest(values) v WHERE v = c)``.

    Unlike ``NOT IN`` a NULL value is kept (no element equals it). The list is
    a parameter, so an ``In`` predicate (pushed to the scan) is exact and
    cheaper than an anti join against a one-column frame.
    """
    vals = list(values)
    col = _col(c)
    if not vals:
        return F.lit(True)
    return col.isNull() | ~col.isin(vals)


def is_true(c: str | Column) -> Column:
    return _col(c).eqNullSafe(F.lit(True))


def is_false(c: str | Column) -> Column:
    return _col(c).eqNullSafe(F.lit(False))


def matches_family(name: str | Column, prefixes: Iterable[str], names: Iterable[str]) -> Column:
    """``name LIKE 'p%' OR ... OR name = 'n' OR ...`` (NULL name -> NULL)."""
    c = _col(name)
    terms = [c.like(p + "%") for p in prefixes] + [c == F.lit(n) for n in names]
    if not terms:
        return F.lit(False)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out
