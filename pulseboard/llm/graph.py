"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.shared import dropped, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root): every vertex of ``edges`` with the smallest vertex it can reach.

    Each round hangs the larger neighbours of every vertex on its smallest
    neighbour (large star) and then the smaller ones (small star), so that the
    depth of every component shrinks by a constant factor a round. Rounds are
    stored in the shared folder; only whether they are over reaches the driver.
    Minimum per vertex is a partial aggregate, and the joins on a hot vertex
    can be split by adaptive execution, so no vertex needs its neighbours in
    one task. Null ends and loops are left out; an empty list gives no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Done when every vertex hangs on one root: no root hangs itself, and nothing hangs twice.
        ends = now.select(F.col("u").alias("w"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        ends = ends.unionByName(now.select(F.col("v").alias("w"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        seen = ends.groupBy("w").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if seen.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
