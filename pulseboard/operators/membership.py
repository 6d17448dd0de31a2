"""Drop rows of a large side early by a bounded set of the other side's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the set; 128 KB whatever the number of keys.
BITS = 1 << 20


def may_be_in(key: str, others: DataFrame, other_key: str, bits: int = BITS) -> Column:
    """A predicate on ``key`` that holds for every key of ``others``, for few
    other values while they are far fewer than ``bits``, and not for NULL.

    The keys are hashed to the bits of one array, built by a scalar subquery
    when the report runs. So the filter sits at the scan, below any roll-up or
    exchange, and moves no row of either side; the join it precedes stays
    exact. With more keys than bits it lets all rows pass, and costs no more.
    """

    def bit(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(bits))

    own = others.filter(F.col(other_key).isNotNull()).select(bit(other_key).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    words = own.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("held"))
    every = others.sparkSession.range(0, bits // 64, 1, 1).withColumnRenamed("id", "word")
    listed = every.join(words, "word", "left").select("word", F.coalesce("held", F.lit(0).cast("bigint")).alias("held"))
    # one row of bits / 64 numbers: a size set by the parameter
    held = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "held"))), lambda x: x["held"]).alias("held"))
    place = F.floor(bit(key) / 64).cast("int")
    word = F.element_at(held.scalar(), place + 1)
    return F.col(key).isNotNull() & (F.getbit(word, (bit(key) % 64).cast("int")) == 1)
