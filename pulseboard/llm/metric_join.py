"""Operator 9: exact range join of embeddings in the metric space of unit vectors.

Copies of one vector under one label become one *class* with a weight. Pivots,
a bounded sample of classes, partition the unit sphere into Voronoi cells; every
label has its own copy of the cells. Two vectors at cosine ``least`` are
r = sqrt(2 - 2 least) apart, so a vector can have a partner in another cell only
if it lies within r of the plane half way between both pivots (the triangle
inequality, sharpened by Euclidean geometry). It is replicated there, from lower
cells to higher ones only, so every pair meets exactly once. Cells join
independently, in pairs of bounded blocks. A block pair returns each member's
weight of links and its local component, never a list of pairs.

A vector that is null or zero, or has a null or non-finite component, or a null
label, links with nothing and is its own component. Vectors of different length
are not compared. Repeated rows are vectors of their own. An empty table gives
no rows; extra columns are left out. Classes are named by a 64-bit hash of label
and vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.graph import components
from pulseboard.llm.shared import stored

LEAST_COSINE = 0.98
#: Vectors of a cell aimed at, pivots at most, vectors of a block.
CELL, PIVOTS, BLOCK = 2048, 256, 1024


def units(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, class, label, x): class is null for a vector that links with nothing."""
    x = F.col(embedding).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda v: v + 0.0).alias("x"), F.coalesce(sound, F.lit(False)).alias("sound"))
    return own.select("vec_id", F.when(F.col("sound"), F.xxhash64("label", "x")).alias("class"), "label", "x")


def cell_rows(distinct: DataFrame, pivots: list[list[float]], least: float) -> DataFrame:
    """(label, size, cell, home, class, weight, x): every class at home and where it visits."""
    by_size: dict[int, np.ndarray] = {}
    for size in {len(p) for p in pivots}:
        by_size[size] = units(pa.array([p for p in pivots if len(p) == size], pa.list_(pa.float64())))
    shared = distinct.sparkSession.sparkContext.broadcast(by_size)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    schema = distinct.select("label", "size", F.lit(0).alias("cell"), F.lit(True).alias("home"), "class", "weight", "x").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                b = whole.filter(pa.array(sizes == size))
                centres = shared.value.get(size)
                if centres is None or len(centres) < 2:
                    yield _cells(b, np.arange(b.num_rows), np.zeros(b.num_rows, np.int32), np.ones(b.num_rows, bool))
                    continue
                between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
                for i in range(0, b.num_rows, 4096):
                    part = b.slice(i, 4096)
                    squares = 2 - 2 * units(part.column(4)) @ centres.T
                    home = squares.argmin(axis=1)
                    beyond = squares - squares[np.arange(len(home)), home][:, None]
                    near = beyond <= 2 * reach * between[home]
                    near &= np.arange(len(centres))[None, :] > home[:, None]
                    rows, cells = np.nonzero(near)
                    at = np.r_[np.arange(len(home)), rows]
                    yield _cells(part, at, np.r_[home, cells].astype(np.int32), np.arange(len(at)) < len(home))

    def _cells(b: pa.RecordBatch, rows: np.ndarray, cells: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        t = b.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(cells, pa.int32()), pa.array(home), t.column(2), t.column(3), t.column(4)], names=["label", "size", "cell", "home", "class", "weight", "x"])

    return distinct.select("label", "size", "class", "weight", "x").mapInArrow(run, schema)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the least row number of each row's component."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _block_pair(least: float):
    def join(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        order = np.argsort(~left, kind="stable")
        t = table.take(pa.array(order))
        x, names, weight = units(t.column("x")), t.column("class").to_numpy(), t.column("weight").to_numpy()
        n = int(left.sum())
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if n < len(x):  # two blocks: only links across
            linked[:n, :n] = False
            linked[n:, n:] = False
        root = local_components(linked)
        some = linked.any(axis=1)
        degree = linked.astype(np.float64) @ weight.astype(np.float64)
        return pa.table({"class": names[some], "links": degree[some].astype(np.int64), "root": names[root[some]]})

    return join


def range_join(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = _classes(vectors, vec_id, embedding, label)
    sound = rows.where("class is not null")
    distinct = stored(sound.groupBy("class").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least")).withColumn("size", F.size("x")), "vectors")
    n = distinct.count()
    k = min(PIVOTS, -(-n // CELL))
    pivots = [list(r.x) for r in distinct.select("class", "x").orderBy(F.xxhash64("class")).limit(k).collect()] if k > 1 else []
    cells = stored(cell_rows(distinct, pivots, least), "cells")

    # Blocks: members of a cell at home against each other, visitors against them.
    place = ["label", "size", "cell"]
    sizes = cells.groupBy(*place).agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_away"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    dealt = cells.join(sizes.select(*place, blocks("n_home").alias("home_blocks"), blocks("n_away").alias("away_blocks"), "n_away"), place)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class", "cell"), F.when(F.col("home"), F.col("home_blocks")).otherwise(F.col("away_blocks"))).cast("int"))
    among = dealt.where("home").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    among = among.select(*place, F.lit(True).alias("at_home"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "class", "weight", "x")
    home_side = dealt.where("home and n_away > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("away_blocks") - 1)))
    home_side = home_side.select(*place, F.lit(False).alias("at_home"), F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), "class", "weight", "x")
    away_side = dealt.where("not home").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    away_side = away_side.select(*place, F.lit(False).alias("at_home"), F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), "class", "weight", "x")
    pairs = among.unionByName(home_side).unionByName(away_side)
    found = stored(pairs.groupBy(*place, "at_home", "i", "j").applyInArrow(_block_pair(least), "class long, links long, root long"), "links")

    parts = components(found.where("class <> root"), "class", "root").withColumnRenamed("id", "class")
    degrees = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = distinct.select("class", "weight", "least").join(parts, "class", "left").join(degrees, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", "class").join(known, "class", "left")
    component = F.coalesce("component", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
