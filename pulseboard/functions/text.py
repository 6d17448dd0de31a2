"""String helpers on activity codes and result labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def product_of(activity: str | Column) -> Column:
    """Product prefix of an activity code: ``split_part(activity, '_', 1)``."""
    return F.split_part(_col(activity), F.lit("_"), F.lit(1))


def fold_other(product: str | Column, products: Iterable[str], other: str) -> Column:
    """Listed products stay, everything else (NULL included) becomes ``other``."""
    return F.when(_col(product).isin(list(products)), _col(product)).otherwise(F.lit(other))


def band(value: str | Column, high: float, medium: float) -> Column:
    """``high`` / ``medium`` / ``low`` by thresholds; NULL stays NULL."""
    v = _col(value)
    return (
        F.when(v >= F.lit(high), F.lit("high"))
        .when(v >= F.lit(medium), F.lit("medium"))
        .when(v < F.lit(medium), F.lit("low"))
    )
