"""Operator 10: language-model scoring by context-tree weighting over bytes.

A text is scored as its tokens: lower-cased words (A-Z only), one space between
them and an end mark. Each byte is eight binary decisions; the context of a
decision is the byte's bits so far and up to ``DEPTH`` bytes before it. Every
node keeps a Krichevsky-Trofimov estimate, and the tree mixes all depths: a
node's weighted probability is half its own estimate and half the product of
its children's.

Counts come from all training texts: tasks count (context, byte) grams, Spark
sums them. Every context that was seen is a node, so the model grows with the
corpus. Contexts of one latest three bytes are weighted together, upper depths
by one ``groupBy`` each; then the shares of the depths go back down, and every
gram gets the log-probability of its byte. Grams that make up at least one in
``FREQUENT_GRAMS`` bytes are looked up in a table of bounded size, all others
(those that no training text has, too) by a join on the gram.

The base score is a unigram with one added: words that make up at least one in
``FREQUENT`` tokens are looked up in a table of bounded size, all others by a
join on the word's hash.

Null and empty texts have the end mark alone. A null id counts as training.
Repeated rows are scored each (and learnt from each). With no training text all
bytes are equally likely. Extra columns are left out. Texts are read whole;
memory follows the longest one. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.shared import LOWER, NOT_SPACE, column_bytes, hash_words, keyed_schema, slices, span_hashes, stored, word_bounds

#: Bytes of context, words and grams looked up in a table at most.
DEPTH, FREQUENT, FREQUENT_GRAMS = 5, 1 << 20, 1 << 22
#: Distinct grams or words that a task holds, and grams that it weights at once (or one group of contexts).
BLOCK, GRAMS = 1_000_000, 50_000
#: Bytes of text of one pass: every byte's gram is sorted with its place.
SLICE = 1 << 20
END = 0x0A


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's texts as scored: bytes with ``DEPTH`` end marks before each text, the places of the
    scored bytes, each text's first among them, the word hashes, and the n+1 word offsets."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    texts = len(n_words)
    lengths = ends - starts
    # Word w of text t begins after all earlier bytes, one separator for each earlier word,
    # one end mark for each earlier text without words, and the marks before each text.
    empty = np.cumsum(np.r_[0, n_words == 0])[:-1]
    text_of = np.repeat(np.arange(texts), n_words)
    begin = np.cumsum(np.r_[0, lengths])[:-1] + np.arange(len(lengths)) + empty[text_of] + DEPTH * (text_of + 1)
    total = int(lengths.sum() + len(lengths) + (n_words == 0).sum() + DEPTH * texts)
    out = np.full(total, END, np.uint8)
    to = np.repeat(begin - starts, lengths)
    source = np.flatnonzero(NOT_SPACE[data])
    out[source + to] = data[source]
    last = np.zeros(len(lengths), bool)
    last[first[1:][n_words > 0] - 1] = True
    out[(begin + lengths)[~last]] = 0x20
    sizes = np.maximum(n_words, 1) + np.add.reduceat(np.r_[lengths, 0], first[:-1]) * (n_words > 0) if texts else np.zeros(0, np.int64)
    text_first = np.cumsum(np.r_[0, sizes])[:-1]
    places = np.arange(int(sizes.sum())) + DEPTH * np.repeat(np.arange(1, texts + 1), sizes)
    return out, places, text_first, hashes, first


def packed_grams(out: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The gram of each scored byte: ``DEPTH`` context bytes and the byte, the latest lowest."""
    grams = np.zeros(len(places), np.int64)
    for back in range(DEPTH, -1, -1):
        grams = grams << 8 | out[places - back]
    return grams


def gather(train: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): counts of grams (kind 0, bytes packed, the latest lowest) and of words (kind 1)."""
    end_word = hash_words([b"\n"]).view(np.int64)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, which, np.concatenate([n for _, n in held]))
        return found, n

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        for b in batches:
            data, offsets = column_bytes(b.column(0))
            for i, j in slices(offsets, SLICE):
                out, places, text_first, words, _ = canonical(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held[0].append(np.unique(packed_grams(out, places), return_counts=True))
                held[1].append(np.unique(np.r_[words.view(np.int64), np.repeat(end_word, len(text_first))], return_counts=True))
                for kind in held:
                    if sum(len(k) for k, _ in held[kind]) > BLOCK:
                        held[kind] = [merged(held[kind])]
                        if len(held[kind][0][0]) > BLOCK // 2:
                            yield rows(kind, *held[kind].pop())
        for kind in held:
            if held[kind]:
                yield rows(kind, *merged(held[kind]))

    return train.select(text).mapInArrow(count, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, with a shift for small arguments."""
    small = x < 8
    z = np.where(small, x + 8, x)
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = np.ones_like(x)
    for k in range(8):
        shift *= np.where(small, x + k, 1.0)
    return out - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)


#: Depth whose contexts are weighted together with all longer ones.
LOCAL = 3


def _mask(depth: int) -> int:
    """Of a decision (context bytes and the node number 1 to 255 below them): the bits of that depth."""
    return (1 << 8 * (depth + 1)) - 1


def _stay(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - own, -60, 60)))


class _Decisions:
    """The decisions of grams from depth ``LOCAL`` to ``DEPTH``, by depth; counts are exact up to 2**53."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        bit = np.arange(8)[:, None]
        byte = key & 255
        self.one = byte >> 7 - bit & 1
        x, up = np.unique((key & ~255 | (1 << bit) + (byte >> 8 - bit)).ravel(), return_inverse=True)
        up = up.ravel()
        zeros, ones = (np.bincount(up, (n * taken).ravel(), len(x)) for taken in (1 - self.one, self.one))
        self.x, self.up, self.chance, self.stay = {DEPTH: x}, {DEPTH: up}, {}, {}
        own = weighted = _log_kt(zeros, ones)
        self.chance[DEPTH] = (ones + 0.5) / (zeros + ones + 1)
        for d in range(DEPTH - 1, LOCAL - 1, -1):
            x, up = np.unique(x & _mask(d), return_inverse=True)
            zeros, ones, below = (np.bincount(up, v, len(x)) for v in (zeros, ones, weighted))
            own = _log_kt(zeros, ones)
            self.x[d], self.up[d], self.chance[d], self.stay[d] = x, up, (ones + 0.5) / (zeros + ones + 1), _stay(own, below)
            weighted = np.logaddexp(own, below) - math.log(2)
        self.zeros, self.ones, self.weighted = zeros, ones, weighted

    def log10(self, x: np.ndarray, mixed_in: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each gram's byte, from what depths above mix in and leave at the decisions x of depth ``LOCAL``."""
        order = np.argsort(x)
        at = order[np.searchsorted(x[order], self.x[LOCAL])]
        mixed_in, left = mixed_in[at], left[at]
        for d in range(LOCAL, DEPTH):
            mixed_in, left = mixed_in + left * self.stay[d] * self.chance[d], left * (1 - self.stay[d])
            # self.up[d] leads from the decisions of depth d + 1 here.
            mixed_in, left = mixed_in[self.up[d]], left[self.up[d]]
        one = (mixed_in + left * self.chance[DEPTH])[self.up[DEPTH]].reshape(8, -1)
        return np.log10(np.where(self.one, one, 1 - one)).sum(axis=0)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of ``GRAMS`` rows or more that hold their groups (the first column) whole."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= GRAMS:
            t = pa.Table.from_batches(held).combine_chunks()
            group = t.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def weighted_grams(grams: DataFrame) -> DataFrame:
    """(key, n, log10): the log-probability of the byte of each gram (key, n) after its context, all
    contexts weighted. Keys are distinct; a gram with n = 0 changes nothing and has its chance told."""
    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOCAL) - 1)).alias("group")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            own = _Decisions(t.column(1).to_numpy(), t.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(own.x[LOCAL]), pa.array(own.zeros.astype(np.int64)), pa.array(own.ones.astype(np.int64)), pa.array(own.weighted)], names=["x", "zeros", "ones", "weighted"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zeros, ones, below = (b.column(k).to_numpy() for k in (1, 2, 3))
            own = _log_kt(zeros.astype(np.float64), ones.astype(np.float64))
            more = [np.logaddexp(own, below) - math.log(2), _stay(own, below), (ones + 0.5) / (zeros + ones + 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, more)], names=["x", "zeros", "ones", "weighted", "stay", "chance"])

    def of_depth(d: int) -> Column:
        return F.col("x").bitwiseAND(F.lit(_mask(d)))

    def above(rows: DataFrame, d: int) -> DataFrame:
        sums = rows.groupBy(of_depth(d).alias("x")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        return sums.mapInArrow(weigh, "x long, zeros long, ones long, weighted double, stay double, chance double")

    local = stored(dealt(grams.select(group, "key", "n")).mapInArrow(up, "x long, zeros long, ones long, weighted double"), "local")
    levels = {}
    for d in range(LOCAL - 1, -1, -1):
        levels[d] = stored(above(levels.get(d + 1, local), d), f"depth-{d}")
    shares = levels[0].select("x", (F.col("stay") * F.col("chance")).alias("mixed_in"), (1 - F.col("stay")).alias("left"))
    for d in range(1, LOCAL):
        # The depths 0 and 1 have at most 255 and 65,280 decisions, whatever the corpus.
        upper = F.broadcast(shares.withColumnRenamed("x", "parent"))
        mixed_in = F.col("mixed_in") + F.col("left") * F.col("stay") * F.col("chance")
        shares = levels[d].withColumn("parent", of_depth(d - 1)).join(upper, "parent").select("x", mixed_in.alias("mixed_in"), (F.col("left") * (1 - F.col("stay"))).alias("left"))
    tops = local.select("x", of_depth(LOCAL - 1).alias("parent")).join(shares.withColumnRenamed("x", "parent"), "parent")
    none = F.lit(None).cast("double")
    rows = grams.select(group, "key", "n", none.alias("mixed_in"), none.alias("left")).unionByName(
        tops.select(F.shiftright("x", 8).alias("group"), F.col("x").alias("key"), F.lit(None).cast("long").alias("n"), "mixed_in", "left")
    )

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            is_gram = t.column(2).is_valid().to_numpy()
            own, top = t.filter(pa.array(is_gram)), t.filter(pa.array(~is_gram))
            key, n = own.column(1).to_numpy(), own.column(2).to_numpy()
            found = _Decisions(key, n).log10(*[top.column(k).to_numpy() for k in (1, 3, 4)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(found)], names=["key", "n", "log10"])

    return dealt(rows).mapInArrow(down, "key long, n long, log10 double")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of ``docs``;
    the last is the code length of a byte."""
    spark = docs.sparkSession
    counts = stored(gather(train, text), "grams")
    grams = counts.where("kind = 0").select("key", "n")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * frequent_grams >= F.lit(total)
    usual = weighted_grams(grams).where(often).select("key", "log10").orderBy("key").toArrow()
    words = counts.where("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = F.col("c") * frequent >= F.lit(size.n)
    top = words.where(common).toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64))
    table = top["word"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order]
    shared = spark.sparkContext.broadcast((usual.column(0).to_numpy(), usual.column(1).to_numpy(), *table))
    end_word = hash_words([b"\n"]).view(np.int64)
    del usual

    def place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        return spot, known[spot] == wanted if len(known) else np.zeros(len(wanted), bool)

    def lists(keys: np.ndarray, text_of: np.ndarray, texts: int) -> pa.ListArray:
        by_text = np.argsort(text_of, kind="stable")
        ends = np.searchsorted(text_of[by_text], np.arange(texts + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[by_text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_grams, chances, known, often = shared.value
        logs = np.log10(often + 1.0)
        for b in batches:
            data, offsets = column_bytes(b.column(2))
            for i, j in slices(offsets, SLICE):
                out, places, text_first, words, first = canonical(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                texts = j - i
                # The words of all texts and then one end mark of each.
                words = np.r_[words.view(np.int64), np.repeat(end_word, texts)]
                text_of = np.r_[np.repeat(np.arange(texts), np.diff(first)), np.arange(texts)]
                spot, hit = place(known, words)
                n_known = np.bincount(text_of[hit], minlength=texts)
                base = np.bincount(text_of[hit], logs[spot[hit]], texts) if len(known) else np.zeros(texts)
                n_bytes = np.diff(np.r_[text_first, len(places)])
                own, which = np.unique(packed_grams(out, places), return_inverse=True)
                at, met = place(known_grams, own)
                found = np.zeros(len(own))
                found[met] = chances[at[met]]
                missed = np.flatnonzero(~met[which])
                missed_of = np.searchsorted(text_first, missed, "right") - 1
                part = b.slice(i, texts)
                columns = [part.column(0), part.column(1), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), lists(words[~hit], text_of[~hit], texts), pa.array(np.add.reduceat(found[which], text_first)), lists(own[which[missed]], missed_of, texts), pa.array(n_bytes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n_tokens", "n_known", "logs", "rare", "score", "rare_grams", "n_bytes"])

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"), F.col(text).alias("text"))
    scored = stored(keyed.mapInArrow(run, keyed_schema(docs, doc_id, "same long, n_tokens long, n_known long, logs double, rare array<long>, score double, rare_grams array<long>, n_bytes long")), "scored")

    # Grams that no training text has are weighted too: their contexts may be known in part.
    met = scored.select("same", F.explode("rare_grams").alias("key"))
    unseen = met.select("key").distinct().join(grams, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n"))
    rest = weighted_grams(stored(grams.unionByName(unseen), "all-grams")).where(~often | (F.col("n") == 0))
    # Rare words and grams: sums by text. Copies of a text add up alike, so their number cancels out.
    by_byte = met.join(rest.select("key", "log10"), "key").groupBy("same").agg(F.count("*").alias("met_grams"), F.sum("log10").alias("rare_score"))
    rare = scored.select("same", F.explode("rare").alias("word")).join(words.where(~common), "word", "left")
    rare = rare.groupBy("same").agg(F.count("*").alias("met"), F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("rare_logs"))
    out = scored.withColumn("n_rare", F.size("rare")).withColumn("n_rare_grams", F.size("rare_grams")).drop("rare", "rare_grams").join(rare, "same", "left").join(by_byte, "same", "left")
    part = lambda c, n, met: F.coalesce(F.col(c) * F.col(n) / F.col(met), F.lit(0.0))
    spread = math.log10(size.n + size.v + 1)
    scored = out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.round(part("rare_known", "n_rare", "met")).cast("long")).alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("logs") + part("rare_logs", "n_rare", "met") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + part("rare_score", "n_rare_grams", "met_grams")).alias("score"),
        "n_bytes",
    )
    return scored.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
