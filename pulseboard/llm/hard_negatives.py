"""Operator 11: hard negatives by LEMP-style pruning of sorted coordinate lists.

Every component x of a vector becomes floor(``scale`` * x); a score is the integer
inner product of two such vectors. An anchor's positives are its first
``positives`` other rows of the same label, by score and then by id. For each of
them, its negatives are the first ``negatives`` rows of other labels whose score
lies within ``band`` per cent of the positive's.

1. Rows are sorted by length and cut into buckets of similar length and bounded
   size. A bucket holds its unit vectors and, per coordinate, the order of their
   values. The index is written once.
2. Anchors go over the index in blocks of bounded size, each a job over all
   buckets (a stated query set against all rows). A score of at least t means an
   angle of at most b to the anchor (t over the lengths of anchor and bucket); a
   coordinate at angle a to the anchor is then between cos(a + b) and cos(a - b).
   Binary searches in the lists of the anchor's largest ``FOCUS`` coordinates turn
   that into ranges, the shortest range is checked against the others, and what is
   left is verified exactly. Whole buckets drop out where no angle is left.
3. The threshold t starts from a bounded sample of all rows, whose scores are
   real ones, and rises bucket by bucket with what has been found. Every task hands
   on at most the asked-for number of rows of an anchor; Spark ranks them.

Rows with a null id, label or vector, or a null or non-finite component take no
part, nor does a vector whose integers could pass 64 bits in an inner product.
Vectors of different lengths are not compared. Rows of one id, label and vector
are one row; an id with several labels or vectors is as many anchors; an anchor's
other rows are those with other ids. No row is dropped or
capped otherwise. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseboard.llm.shared import dropped, scratch_path, stored

#: Factor of the components; positives and negatives of an anchor; per cent of a positive's score.
SCALE, POSITIVES, NEGATIVES, BAND = 256, 5, 10, (30, 90)
#: Rows of a bucket and of a partition of the index, anchors of a block, sampled rows, coordinates searched.
BUCKET, PART, ANCHORS, SAMPLE, FOCUS = 4096, 1 << 14, 2048, 4096, 4
#: Components of a bucket at most, so that longer vectors come in fewer rows.
COMPONENTS = 1 << 22
#: Rounding of unit vectors and angles: ranges are this much wider.
SLACK = 1e-6


def _prepared(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, x, size, norm) of the rows that take part, x as integers."""
    x = F.col(embedding).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    own = own.where("vec_id is not null and label is not null and x is not null").where(F.forall("x", finite))
    # |x| < sqrt(2^62 / size) keeps every inner product within 64 bits.
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("x"), F.lit(1)))
    own = own.where(F.forall("x", lambda v: F.abs(v * float(scale)) + 1 < most))
    own = own.withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))).distinct()
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return own.select("vec_id", "label", "x", F.size("x").alias("size"), norm.alias("norm"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def exact_scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: in doubles where all sums are below 2^53, else as integers."""
    if rows.size and anchors.size and float(np.abs(rows).max()) * float(np.abs(anchors).max()) * rows.shape[1] < 2**53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    return rows @ anchors.T


def _index(rows: DataFrame, bucket: int, part: int) -> DataFrame:
    """One row a bucket: its ids, labels and integer vectors, the order of each coordinate, and its longest vector."""
    parts = -(-rows.count() // part)
    ordered = rows.repartitionByRange(max(1, parts), "size", F.desc("norm"), "vec_id").sortWithinPartitions("size", F.desc("norm"), "vec_id", "label")

    def held(b: pa.Table) -> pa.RecordBatch:
        x = _matrix(b.column("x"))
        norm = b.column("norm").to_numpy()
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32 if len(x) > 1 << 15 else np.int16)
        fields = [("size", x.shape[1], pa.int32()), ("longest", float(norm.max()), pa.float64()), ("n", len(x), pa.int32())]
        fields += [(k, v.tobytes(), pa.binary()) for k, v in (("ids", b.column("vec_id").to_numpy()), ("labels", b.column("label").to_numpy()), ("x", x), ("lists", order))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for _, v, t in fields], names=[k for k, *_ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            kept = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            while len(kept):
                size = kept.column("size").to_numpy()
                same = int(np.searchsorted(size, size[0], "right"))
                full = min(bucket, max(1, COMPONENTS // max(1, int(size[0]))))
                if same == len(kept) and same < full:
                    break
                yield held(kept.slice(0, min(same, full)))
                kept = kept.slice(min(same, full))
        if kept is not None and len(kept):
            yield held(kept)

    return ordered.mapInArrow(run, "size int, longest double, n int, ids binary, labels binary, x binary, lists binary")


@dataclass
class Bucket:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    longest: float
    lists: np.ndarray
    unit: np.ndarray

    @staticmethod
    def of(row: dict) -> Bucket:
        x = np.frombuffer(row["x"], np.int64).reshape(row["n"], row["size"])
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        lists = np.frombuffer(row["lists"], np.int32 if row["n"] > 1 << 15 else np.int16).reshape(row["size"], row["n"])
        return Bucket(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x, row["longest"], lists, x / np.where(norm > 0, norm, 1)[:, None])

    def candidates(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more against an anchor; None for all rows."""
        if least <= 0 or not len(unit):
            return None
        cosine = least / (length * self.longest) - SLACK if length and self.longest else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        wide = np.arccos(max(-1.0, cosine))
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, own + wide)) - SLACK
        high = np.cos(np.maximum(0, own - wide)) + SLACK
        ranges = []
        for f, lo, hi in zip(focus, low, high):
            order, values = self.lists[f], self.unit[:, f]
            ranges.append((int(np.searchsorted(values, lo, sorter=order)), int(np.searchsorted(values, hi, "right", sorter=order))))
        short = min(range(len(ranges)), key=lambda k: ranges[k][1] - ranges[k][0])
        i, j = ranges[short]
        if 2 * (j - i) > len(self.ids):
            return None  # the lists rule out too little
        rows = self.lists[focus[short]][i:j]
        for k, f in enumerate(focus):
            if k != short:
                v = self.unit[rows, f]
                rows = rows[(v >= low[k]) & (v <= high[k])]
        return rows


@dataclass
class Block:
    """A block of anchors of one length, with its wanted bands: lowest and highest score, rows to return, and
    the threshold that the sample gives; ``same`` asks for the anchor's own label, else for the others."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    least: list[np.ndarray]
    same: bool
    k: int


def _firsts(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The first k rows by score, then by id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(buckets: Iterator[Bucket], block: Block) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(anchor, lowest score, highest score, ids, scores): the first rows of each band of each anchor."""
    lengths = np.sqrt((block.x.astype(np.float64) ** 2).sum(axis=1))
    units = block.x / np.where(lengths > 0, lengths, 1)[:, None]
    held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(b) for b in block.low]
    least = [b.copy() for b in block.least]
    for bucket in buckets:
        everything = []
        picked = {}
        for a in range(len(block.ids)):
            if len(block.low[a]):
                rows = bucket.candidates(units[a], lengths[a], float(least[a].min()))
                if rows is None:
                    everything.append(a)
                elif len(rows):
                    picked[a] = rows
        # Anchors without a useful range are verified against the bucket together.
        for i in range(0, len(everything), 512):
            some = everything[i : i + 512]
            scores = exact_scores(bucket.x, block.x[some])
            for k, a in enumerate(some):
                _merge(bucket.ids, bucket.labels, scores[:, k], block, a, held[a], least[a])
        for a, rows in picked.items():
            _merge(bucket.ids[rows], bucket.labels[rows], exact_scores(bucket.x[rows], block.x[a : a + 1])[:, 0], block, a, held[a], least[a])
    for a in range(len(block.ids)):
        for k, (ids, scores) in enumerate(held[a]):
            if len(ids):
                yield a, int(block.low[a][k]), int(block.high[a][k]), ids, scores


def _merge(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, block: Block, a: int, held: list, least: np.ndarray) -> None:
    fits = ((labels == block.labels[a]) == block.same) & (ids != block.ids[a])
    fits &= (scores >= least.min()) & (scores <= block.high[a].max())
    at = np.flatnonzero(fits)
    if not len(at):
        return
    ids, scores = ids[at], scores[at]
    for k in range(len(least)):
        some = (scores >= least[k]) & (scores <= block.high[a][k])
        if some.any():
            own, value = np.concatenate([held[k][0], ids[some]]), np.concatenate([held[k][1], scores[some]])
            first = _firsts(own, value, block.k)
            held[k] = own[first], value[first]
            if len(first) == block.k:
                least[k] = max(least[k], value[first[-1]])


def _found(index: DataFrame, block: Block, size: int) -> DataFrame:
    """(anchor, low, high, vec_id, score): each task's first rows of every band of the anchors, which go by their
    numbers in the block."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        buckets = (Bucket.of(row) for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
        rows = list(search(buckets, own))
        n = [len(r[3]) for r in rows]
        said = np.repeat([r[0] for r in rows], n).astype(np.int64)
        ends = [np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in (1, 2)]
        values = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (said, *ends, *values)], names=["anchor", "low", "high", "vec_id", "score"])

    schema = "anchor long, low long, high long, vec_id long, score long"
    return index.where(F.col("size") == size).mapInArrow(run, schema)


def _started(block: Block, sample: list[Bucket]) -> Block:
    """Thresholds from the sample: the last of the first k scores of a band, where the sample holds as many.

    Sampled rows are rows of the table, so no first row of the whole scores less.
    """
    for a, low, high, ids, scores in search(iter(sample), block):
        if len(ids) == block.k:
            at = np.flatnonzero((block.low[a] == low) & (block.high[a] == high))
            block.least[a][at] = np.maximum(block.least[a][at], scores[-1])
    return block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    band = Window.partitionBy("anchor", "low", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(band)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells the anchors by columns ``vec_id`` and ``label``.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = stored(_prepared(vectors, vec_id, embedding, label, scale), "rows")
    index = stored(_index(rows, BUCKET, PART), "index")
    sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).collect()
    asked = rows.where(anchor)
    out = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for size, n in sorted((r["size"], r["count"]) for r in asked.groupBy("size").count().collect()):
        near = _buckets([r for r in sample if r["size"] == size])
        blocks = -(-n // ANCHORS)
        # Blocks of bounded size: ids are dealt by hash, and each block is collected on its own.
        dealt = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))
        for k in range(blocks):
            some = asked.where((F.col("size") == size) & (dealt == k)).select("vec_id", "label", "x").collect()
            if some:
                found = _of_block(index, some, size, near, positives, negatives, band)
                found.write.mode("append").parquet(out)
    dropped(rows, index)
    return spark.read.schema(schema).parquet(out)


def _buckets(sample: list) -> list[Bucket]:
    if not sample:
        return []
    x = np.array([r.x for r in sample], np.int64).reshape(len(sample), len(sample[0].x))
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    lists = np.argsort(unit, axis=0, kind="stable").T
    return [Bucket(np.array([r.vec_id for r in sample], np.int64), np.array([r.label for r in sample], np.int64), x, float(norm.max()), lists, unit)]


def _of_block(index: DataFrame, anchors: list, size: int, sample: list[Bucket], positives: int, negatives: int, band: tuple[int, int]) -> DataFrame:
    spark = index.sparkSession
    ids, labels = np.array([r.vec_id for r in anchors], np.int64), np.array([r.label for r in anchors], np.int64)
    x = np.array([r.x for r in anchors], np.int64).reshape(len(anchors), size)
    floor, ceiling = np.int64(-(1 << 63)), np.int64((1 << 63) - 1)

    def block(low: list[np.ndarray], high: list[np.ndarray], same: bool, k: int) -> Block:
        return _started(Block(ids, labels, x, low, high, [b.copy() for b in low], same, k), sample)

    whole = [np.array([v], np.int64) for v in (floor, ceiling)]
    first = _ranked(_found(index, block([whole[0]] * len(ids), [whole[1]] * len(ids), True, positives), size), positives)
    # At most `positives` rows an anchor of the block; equal scores share a band.
    pairs, bands = [], [set() for _ in anchors]
    for r in first.collect():
        low, high = -(-band[0] * r.score // 100), band[1] * r.score // 100
        pairs.append((r.anchor, int(ids[r.anchor]), r.vec_id, r.score, low, high))
        if low <= high:
            bands[r.anchor].add((low, high))
    ends = [[np.array(sorted(own), np.int64).reshape(-1, 2)[:, k] for own in bands] for k in (0, 1)]
    hard = _ranked(_found(index, block(*ends, False, negatives), size), negatives)
    wanted = spark.createDataFrame(pairs, "anchor long, anchor_id long, positive_id long, positive_score long, low long, high long")
    both = wanted.join(hard, ["anchor", "low", "high"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
