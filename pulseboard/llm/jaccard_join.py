"""Operator 3: exact n-gram Jaccard join in regions of shingle and document pivots.

Documents are sets of 64-bit hashes of five-word shingles; copies of one set are
one *class* from the first task on. Two classes link at Jaccard similarity
``percent`` / 100 or more, that is at distance r = 1 - percent / 100 or less.

*Regions.* Most distances are 1, so document pivots cannot divide all classes:
the first pivots are the shingles themselves. A class belongs to the regions of
its first ``n - ceil((1 - r) n) + 1`` shingles in one order of all of them
(rarest first by a sketch of document counts, then by hash); a class within r
of it shares one. Regions with one member end there; members of very frequent
shingles are dealt over sub-regions.

*Document pivots.* In every region one member is the pivot, and the distance of
each member to it is kept: exactly where the parity sketches (their distance
never exceeds that of the sets) allow a link, else as a lower bound. Members
link to a near pivot. Regions with one pivot form one Voronoi *cell* of that
document, so a class that meets another in many regions meets it in few cells.
Cells whose members are in one component by then are settled. The others are
entered again with another member as pivot while their pairs are many; each time,
members also link to those of ``HUBS`` members of the cell that the bounds below
leave, so that a group of near copies meets a few of its members and not itself.

*Windows.* What remains are pairs of a cell in different components. The triangle
inequality on the kept distances to the pivot (|d(x, p) - d(y, p)| <= r), sizes
and short parity sketches leave few, each pair is taken once, and the rest is
verified on the whole sets. No link between components is lost, and the links of
a large group of copies are never listed pair by pair.

Words are runs of bytes other than white space, A-Z lower-cased. A text of one
to four words has one shingle, the whole sequence. Null, empty and wordless
texts have none: they are their own component. A null id joins like any other;
components are named by the smallest non-null id. Repeated rows give repeated
rows. Extra columns are left out. Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseboard.llm.graph import components
from pulseboard.llm.shared import LOWER, NOT_SPACE, column_bytes, dropped, keyed_schema, mixed, returning, slices, small, span_hashes, stored, summed_array, word_bounds

SHINGLE, PERCENT = 5, 75
#: Counters of the sketch that orders pivots, and of the bitmap of classes to verify.
SKETCH, BITMAP = 1 << 20, 1 << 20
#: 64-bit words of the short sketch that every member of an unsettled region carries.
SHORT = 16
#: Estimated members of a sub-region of a frequent pivot.
SUB_REGION = 1024
#: Times a region is entered with a new pivot at most before its last pairs are compared.
TURNS = 3
#: Pairs left for each member beyond which they are many.
MANY = 64
#: Members that a cell's others are held against, besides its pivot, whenever it is entered again.
HUBS = 64
#: Distances to pivots are kept in these parts of 1.
SCALE = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    odd = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * odd[k]
    rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif b > a:
            whole = np.array([sum(int(w) * int(odd[k]) for k, w in enumerate(words[a:b])) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)
            yield mixed(whole)
        else:
            yield np.zeros(0, np.uint64)


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set, signed for Spark."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        h = mixed(np.array([mixed(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))
    return int(h.view(np.int64)[0])


def parity(own: np.ndarray) -> bytes:
    """Parities of the set's members by the low bits of their hashes, two bits a member or more."""
    m = max(64, 1 << int(2 * len(own) - 1).bit_length())
    counts = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def short_parity(own: np.ndarray) -> np.ndarray:
    """The parities folded onto ``SHORT`` words, whatever the set's size."""
    counts = np.bincount((own & np.uint64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference: the longer sketch folds onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _per_text(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = column_bytes(column)
    for i, j in slices(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, class, sketch, short): a row per document; the sketches on the first of a class in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, sketches, short, seen = [], [], [], [], set()
            for own in _per_text(b.column(1)):
                name = class_of(own)
                sizes.append(len(own))
                names.append(name)
                first = len(own) and name not in seen
                sketches.append(parity(own) if first else None)
                short.append(short_parity(own) if first else None)
                seen.add(name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary()), pa.array(short, pa.list_(pa.int64()))], names=["doc_id", "n", "class", "sketch", "short"])

    return docs.select(doc_id, text).mapInArrow(returning(run), keyed_schema(docs, doc_id, "n long, class long, sketch binary, short array<long>"))


def _distinct_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    seen: set[int] = set()
    for own in _per_text(batch.column(0)):
        name = class_of(own)
        if len(own) and name not in seen:
            seen.add(name)
            yield name, own


def regions(docs: DataFrame, counts: np.ndarray, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(pivot, part, class, n): the regions of every class."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts.astype(np.int64))
    usual = float(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            found: list[tuple] = []
            held = 0
            for name, own in _distinct_sets(b):
                n = len(own)
                seen = often[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
                window = n - -(-percent * n // 100) + 1
                order = np.argsort(seen, kind="stable")[:window]  # ties keep the order of hashes
                extra = seen[order] - usual
                parts = np.where(extra > SUB_REGION + usual, extra // SUB_REGION + 1, 1).astype(np.int64)
                part = np.where(parts > 1, abs(name) % parts, -1)
                found.append((own[order].view(np.int64), part.astype(np.int32), np.full(window, name), np.full(window, n, np.int32)))
                held += window
                if held > 1 << 18:
                    yield _rows(found)
                    found, held = [], 0
            if found:
                yield _rows(found)

    return docs.select(text).mapInArrow(returning(run), "pivot long, part int, class long, n int")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pivot", "part", "class", "n"])


def _sketch_bounds(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, na, nb, apart) of the pairs (a, b): ``apart`` is at most the size of the symmetric difference."""
    with_a = pairs.join(sketches.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(sketches.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            apart = [parity_distance(x.as_py(), y.as_py()) for x, y in zip(t.column(4), t.column(5))]
            yield pa.RecordBatch.from_arrays([*t.columns[:4], pa.array(apart, pa.int64())], names=["a", "b", "na", "nb", "apart"])

    return with_b.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na long, nb long, apart long")


def _shared(docs: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b, ...) with ``shared``, the shingles in both whole sets.

    Sets come from another pass over the texts; a bitmap of fixed size keeps
    the classes that no pair needs out of the shuffle (false hits only add rows).
    """
    def mark(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for column in batch.columns:
            total[column.to_numpy() & (BITMAP - 1)] = 1

    bits = np.packbits(summed_array(pairs.select("a", "b"), BITMAP, mark) > 0, bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for b in batches:
            names, sets, held = [], [], 0
            for name, own in _distinct_sets(b):
                cell = name & (BITMAP - 1)
                if marked[cell >> 3] >> (cell & 7) & 1:
                    names.append(name)
                    sets.append(own.view(np.int64))
                    held += len(own)
                    if held > 1 << 18:
                        yield _set_rows(names, sets)
                        names, sets, held = [], [], 0
            if names:
                yield _set_rows(names, sets)

    sets = docs.select(text).mapInArrow(returning(run), "class long, members array<long>").dropDuplicates(["class"])
    sets = stored(sets, "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("class").alias("b"), F.col("members").alias("mb")), "b")
    counted = stored(both.select(*pairs.columns, F.size(F.array_intersect("ma", "mb")).cast("long").alias("shared")), "shared")
    dropped(sets)
    return counted


def _set_rows(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["class", "members"])


def _sizes_allow(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, components (id, root) of linked classes)."""
    documents = stored(classes(docs, doc_id, text), "classes")
    sketches = documents.where("sketch is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), *[F.first(F.col("short")[k]).alias(f"p{k}") for k in range(SHORT)])
    sketches = stored(sketches, "sketches")

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, own in _distinct_sets(batch):
            np.add.at(total, (own & np.uint64(SKETCH - 1)).astype(np.int64), 1)

    counts = summed_array(docs.select(text), SKETCH, add)
    region = Window.partitionBy("pivot", "part")
    rows = regions(docs, counts, text, percent).withColumn("hub", F.min(_draw(0)).over(region))
    alone = F.min("class").over(region) == F.max("class").over(region)
    # Only sub-regions need their shingle from here on: other regions with one document pivot are one cell.
    shingle = F.when(F.col("part") >= 0, F.col("pivot")).alias("pivot")
    members = rows.withColumn("alone", alone).where("not alone or part >= 0").select(shingle, "class", "n", "hub")
    members = stored(members.distinct(), "members")

    # The pivots of sub-regions meet one of the whole region, whose cell it becomes.
    hubs = members.where("pivot is not null").select("pivot", "hub").distinct()
    tops = hubs.groupBy("pivot").agg(F.min("hub").alias("top"))
    above = hubs.join(tops, "pivot").select(F.col("hub.class").alias("a"), F.col("hub.n").alias("an"), F.col("top.class").alias("b"), F.col("top.n").alias("bn"))
    to_hub = members.select(F.col("class").alias("a"), F.col("n").alias("an"), F.col("hub.class").alias("b"), F.col("hub.n").alias("bn"))
    known = _distances(docs, to_hub.unionByName(above), sketches, text, percent)
    parts = stored(components(known.where("linked"), "a", "b"), "parts")

    plain = members.where("pivot is null").select(F.col("hub.class").alias("cell"), "class", "n")
    dealt = members.join(tops, "pivot").select(F.col("top.class").alias("cell"), "class", "n")
    cells = _unsettled(plain.unionByName(dealt).distinct(), parts, sketches, known)
    dropped(members, known)
    for turn in range(1, TURNS):
        rest = cells.groupBy("cell", "root").agg(F.count("*").alias("k")).groupBy("cell").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("twice"), F.sum("k").alias("k"))
        left = rest.agg(F.coalesce(F.sum(F.col("twice").cast("double")) / 2, F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
        if left.pairs <= MANY * left.k:
            break
        hubs = cells.groupBy("cell").agg(F.min(_draw(turn)).alias("hub"))
        cells, old = stored(cells.join(hubs, "cell"), "entered"), cells
        dropped(old)
        to_hub = cells.where("root <> hub.root").select(F.col("class").alias("a"), F.col("n").alias("an"), F.col("hub.class").alias("b"), F.col("hub.n").alias("bn"))
        # A draw by hash deals the members into slots; the least of a slot is held against the cell.
        slot = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(HUBS))
        some = cells.groupBy("cell", slot).agg(F.min(F.struct("class", *[c for c in cells.columns if c not in ("cell", "class", "hub")])).alias("y"))
        to_some = _near_pairs(cells.alias("x"), some.select("cell", "y.*").alias("y"), percent)
        known = _distances(docs, to_hub.unionByName(to_some), sketches, text, percent)
        parts = _joined(parts, known.where("linked"))
        # The old pivot's cell keeps its members; their distances are to the new one now.
        same = cells.select("cell", F.col("hub.class").alias("pivot"), "class", "n")
        cells, old = _unsettled(same, parts, sketches, known, "pivot"), cells
        dropped(old, known)

    cross = _near_pairs(cells.alias("x"), cells.alias("y"), percent, ordered=True)
    known = _distances(docs, cross, sketches, text, percent)
    parts = _joined(parts, known.where("linked"))
    dropped(cells, sketches)
    return documents, parts


def _near_pairs(x: DataFrame, y: DataFrame, percent: int, ordered: bool = False) -> DataFrame:
    """(a, an, b, bn): members of one cell, but of two components, that no bound keeps from a link;
    with ``ordered`` only those where a < b."""
    r = SCALE * (100 - percent) // 100
    # The short sketches bound the symmetric difference from below, as the long ones do.
    apart = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(SHORT)])
    near = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    window = (F.col("x.low") - F.col("y.high") <= r) & (F.col("y.low") - F.col("x.high") <= r)
    once = F.col("x.class") < F.col("y.class") if ordered else F.lit(True)
    found = x.join(y, (F.col("x.cell") == F.col("y.cell")) & once & (F.col("x.root") != F.col("y.root")) & _sizes_allow("x.n", "y.n", percent) & window & near)
    return found.select(F.col("x.class").alias("a"), F.col("x.n").alias("an"), F.col("y.class").alias("b"), F.col("y.n").alias("bn"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, root) of the links together with those found before.

    The links are between components, few of them: only their roots are searched.
    """
    if links.isEmpty():
        return parts
    rooted, near = links.select("a", "b"), small(parts)
    for end in ("a", "b"):
        root = near.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        rooted = rooted.join(root, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    merged = components(rooted, "a_root", "b_root").select(F.col("id").alias("root"), F.col("root").alias("merged"))
    moved = parts.join(merged, "root", "left").select("id", F.coalesce("merged", "root").alias("root"))
    # Classes without a link before are roots of their own.
    alone = merged.join(parts.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("merged").alias("root"))
    return stored(moved.unionByName(alone), "parts")


def _draw(turn: int) -> F.Column:
    """A region's next pivot is its least member by this, so near regions often draw the same document."""
    fields = ["class", "n"] + (["root"] if turn else [])
    return F.struct(F.xxhash64("class", F.lit(turn)).alias("draw"), *fields)


def _distances(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, text: str, percent: int) -> DataFrame:
    """(a, b, linked, low, high) of the pairs (a, an, b, bn) of classes and sizes: bounds of the distance in
    parts of ``SCALE``, equal up to rounding where the sketches allow a link."""
    pairs = pairs.where((F.col("a") != F.col("b")) & _sizes_allow("an", "bn", percent))
    bounds = stored(_sketch_bounds(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sketches), "bounds")
    # At similarity s the symmetric difference is at most (1 - s) / (1 + s) of both sizes.
    near = F.col("apart") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    counted = _shared(docs, bounds.where(near), text)
    both = counted.unionByName(bounds.where(~near).withColumn("shared", F.lit(None).cast("long")))
    sizes = F.col("na") + F.col("nb")
    most = F.coalesce("shared", F.least("na", "nb", F.call_function("div", sizes - F.col("apart"), F.lit(2))))
    # The distance is (sizes - 2 most) / (sizes - most), rounded down and up in whole numbers.
    part, whole = SCALE * (sizes - 2 * most), sizes - most
    low = F.call_function("div", part, whole)
    high = F.when(F.col("shared").isNotNull(), F.call_function("div", part + whole - 1, whole)).otherwise(F.lit(SCALE))
    linked = F.coalesce(100 * F.col("shared") >= percent * (sizes - F.col("shared")), F.lit(False))
    out = stored(both.select("a", "b", linked.alias("linked"), low.alias("low"), high.alias("high")), "distances")
    dropped(bounds, counted)
    return out


def _unsettled(cells: DataFrame, parts: DataFrame, sketches: DataFrame, known: DataFrame, pivot: str = "cell") -> DataFrame:
    """Members of the cells that hold several components: with their components, their short sketches, and the
    bounds of their distance to the pivot (0 and 1 where it was not compared)."""
    roots = small(parts).withColumnRenamed("id", "class")
    rooted = cells.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # An aggregate and a join: both may split a cell that holds many classes.
    several = rooted.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell")
    short = [f"p{k}" for k in range(SHORT)]
    kept = rooted.join(several, "cell", "left_semi").join(sketches.select("class", *short), "class")
    at_pivot = F.col("class") == F.col(pivot)
    ends = {"a": F.least("class", pivot), "b": F.greatest("class", pivot), "at pivot": at_pivot}
    bounded = kept.withColumns(ends).join(small(known).select("a", "b", "low", "high"), ["a", "b"], "left")
    low = F.when(F.col("at pivot"), 0).otherwise(F.coalesce("low", F.lit(0))).cast("long")
    high = F.when(F.col("at pivot"), 0).otherwise(F.coalesce("high", F.lit(SCALE))).cast("long")
    return stored(bounded.select("cell", "class", "n", "root", *short, low.alias("low"), high.alias("high")), "cells")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    documents, parts = near_duplicate_classes(docs, doc_id, text, percent)
    roots = small(parts).withColumnRenamed("id", "class")
    named = documents.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = named.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = rooted.join(smallest, "root").select("class", "component")
    out = documents.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(by_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
