"""Operator 13: toxicity by multiple-instance learning.

A document is a bag of sentences, cut at ``. ! ?`` and line ends. A sentence holds
the hashed words (runs of letters, digits and non-ASCII characters, A-Z lowered)
and the hashed first 3 to 6 characters of longer words, each once; one of more
than ``SENTENCE`` words is cut into runs of that many. A linear model gives every
sentence a probability p; the bag's is a noisy-or of its sentences and a leak,
P = 1 - (1 - leak) * prod(1 - p). Only documents are labelled: the gradient of
the log loss, p * (P - y) / P for a sentence, credits the sentences that
explain a toxic document. Follow-the-regularised-leader with elastic-net
penalties runs it over a bounded sample: about ``PER_CLASS`` (at most twice as
many) labelled documents of each class, of at most ``SAMPLED_BYTES`` bytes each,
weighted so that the classes count as often as among all labels, in an order in
which both classes are mixed evenly, as the steps follow the rows. Scores read
whole texts, and the sentences that reach ``least`` are located.

Null and empty texts, and those without words, have no sentence: their score is
the leak. Without labels of both classes all scores are the share of toxic
labels (0 without any). Documents labelled more than once are toxic if one label says
so; null labels and ids teach nothing. Repeated rows give repeated rows; extra columns
are left out. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseboard.llm.shared import ALNUM, LOWER, byte_class, column_bytes, keyed_schema, mixed, slices, span_hashes, word_bounds

#: Hashed features; characters of the word beginnings; words of a sentence at most; words handled at once.
FEATURES, STEMS, SENTENCE, BLOCK = 1 << 20, (3, 4, 5, 6), 1000, 1 << 18
#: Sampled documents of a class, and the longest of them.
PER_CLASS, SAMPLED_BYTES = 1500, 1 << 16
#: Step size, its offset, elastic-net penalties, passes over the sample; a sentence's and the leak's first log odds.
ALPHA, BETA, L1, L2, EPOCHS, BIAS, LEAK = 0.5, 1.0, 0.5, 0.02, 6, -7.0, -5.0
#: A sentence from here on is located as toxic.
LEAST = 0.3

_STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x0A, 0x0A), (0x0D, 0x0D))


@dataclass
class Bags:
    """The sentences of a run of texts: word bounds in bytes, first word of each sentence, and its text."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        last = np.append(self.first[1:], len(self.starts)) - 1
        return self.starts[self.first], self.ends[last]

    def features(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sentence, feature) of whole sentences, about ``BLOCK`` words at a time."""
        i, n = 0, len(self.first)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + BLOCK)))
            a, b = self.first[i], self.first[j] if j < n else len(self.starts)
            lo, hi = self.starts[a], self.ends[b - 1]
            low, s, e = self.low[lo:hi], self.starts[a:b] - lo, self.ends[a:b] - lo
            sentence = np.repeat(np.arange(i, min(j, n)), np.diff(np.append(self.first[i:j], b)))
            chars = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
            at = np.searchsorted(chars, s)
            length = np.searchsorted(chars, e) - at
            longer = [np.flatnonzero(length > k) for k in STEMS]
            tails = [chars[at[rows] + k] for k, rows in zip(STEMS, longer)]
            hashes = span_hashes(low, np.concatenate([s, *[s[rows] for rows in longer]]), np.concatenate([e, *tails]))
            hashes[len(s) :] = mixed(hashes[len(s) :] + np.uint64(1))  # a stem is no word
            yield np.concatenate([sentence, *[sentence[rows] for rows in longer]]), (hashes % np.uint64(size)).astype(np.int64)
            i = j


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    low = LOWER[data]
    starts, ends, of_text = word_bounds(low, offsets, ALNUM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of_text))
    stops = np.flatnonzero(_STOP[low])
    new = np.ones(len(starts), bool)
    new[1:] = (np.searchsorted(stops, starts[1:]) > np.searchsorted(stops, ends[:-1])) | (text[1:] != text[:-1])
    nth = np.arange(len(starts))
    new |= (nth - np.maximum.accumulate(np.where(new, nth, 0))) % SENTENCE == 0
    first = np.flatnonzero(new)
    return Bags(low, starts, ends, first, text[first])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """Weights by feature, the log odds of a sentence without any, and of the leak (null: no sentence counts)."""

    weights: np.ndarray
    bias: float
    leak: float
    constant: float | None = None

    def sentences(self, found: Bags) -> np.ndarray:
        z = np.full(len(found.first), self.bias)
        if self.constant is None:
            for sentence, feature in found.features(len(self.weights)):
                some = np.flatnonzero(self.weights[feature])
                once = np.unique(sentence[some] * len(self.weights) + feature[some])
                at = once // len(self.weights)
                np.add.at(z, at, self.weights[once % len(self.weights)].astype(np.float64))
        return _sigmoid(z)

    def documents(self, found: Bags, p: np.ndarray, n: int) -> np.ndarray:
        """The noisy-or over the sentences of each of ``n`` texts."""
        if self.constant is not None:
            return np.full(n, self.constant)
        clear = np.bincount(found.text, weights=np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=n)[:n]
        return -np.expm1(clear + np.log1p(-_sigmoid(np.array(self.leak))))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int, float]], features: int) -> Model:
    """FTRL-proximal on the noisy-or loss; rows are (features, sentence of each, label, weight).

    Coordinate ``features`` is the sentences' bias and the next one the leak; both are unpenalised and start at
    ``BIAS`` and ``LEAK``.
    """
    z, n = np.zeros(features + 2), np.zeros(features + 2)
    start = {features: BIAS, features + 1: LEAK}
    ends = np.array([features, features + 1])

    def weight(at: np.ndarray) -> np.ndarray:
        zs, plain = z[at], at < features
        l1, l2 = np.where(plain, L1, 0.0), np.where(plain, L2, 0.0)
        w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))
        return w

    for _ in range(EPOCHS):
        for feature, sentence, label, share in rows:
            some, number = np.unique(feature, return_inverse=True)
            at = np.append(some, ends)
            w = weight(at)
            count = int(sentence[-1]) + 1 if len(sentence) else 0
            logit = np.bincount(sentence, weights=w[number], minlength=count) + w[-2] + start[features]
            p = np.append(_sigmoid(logit[:count]), _sigmoid(np.array(w[-1] + start[features + 1])))
            bag = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
            slope = share * p * ((bag - label) / bag)
            g = np.bincount(number, weights=slope[sentence], minlength=len(some))
            g = np.append(g, [slope[:-1].sum(), slope[-1]])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    final = weight(np.arange(features + 2))
    return Model(final[:features].astype(np.float32), float(final[features] + BIAS), float(final[features + 1] + LEAK))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """Learns from ``labels`` (all of them may be used); the sample's features are what reaches the driver."""
    known = labels.select(F.col(label_id).alias("k"), F.col(toxic).alias("y")).where("k is not null and y is not null")
    known = known.groupBy("k").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    none = Model(np.zeros(features, np.float32), BIAS, LEAK, sizes.get(1, 0) / total if total else 0.0)
    if len(sizes) < 2:
        return none
    grid, most = 1 << 30, 4 * per_class
    wanted = {y: min(grid, int(grid * per_class / n) + 1) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64("k", F.lit(13)), F.lit(grid))
    drawn = known.where(draw < F.when(F.col("y") == 1, wanted[1]).otherwise(wanted[0]))
    # The draws of the rarer class reach further, so they are no order to learn in: it would end with that class alone.
    drawn = drawn.withColumn("nth", F.xxhash64("k", F.lit(29))).orderBy("nth", "k").limit(most)

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = bags(*column_bytes(b.column(2).slice(i, 1)))
                pairs = [np.unique(s * features + f) for s, f in found.features(features)]
                both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                parts = [(both % features).astype(np.int32).tobytes(), (both // features).astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *[pa.array([x], pa.binary()) for x in parts]], names=["nth", "y", "f", "s"])

    # The sampled ids are few by their limit, so they go to the texts.
    texts = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLED_BYTES)
    sample = texts.join(F.broadcast(drawn), "k").select("nth", "y", "t").mapInArrow(of_text, "nth long, y int, f binary, s binary")
    got = sample.orderBy("nth", "y", F.xxhash64("f", "s")).limit(most).collect()
    sampled = {y: sum(r.y == y for r in got) for y in sizes}
    if not all(sampled.values()):
        return none
    shares = {y: sizes[y] / total * len(got) / sampled[y] for y in sizes}
    return learn([(np.frombuffer(r.f, np.int32).astype(np.int64), np.frombuffer(r.s, np.int32), r.y, shares[r.y]) for r in got], features)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, score, n_sentences, toxic_sentences) of every row; the last are (start, end, score)
    of the sentences whose own probability is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = keyed_schema(docs, doc_id, "score double, n_sentences long").add("toxic_sentences", T.ArrayType(span, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            for i, j in slices(offsets):
                raw, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = bags(raw, cuts)
                p = own.sentences(found)
                total = own.documents(found, p, j - i)
                bad = np.flatnonzero(p >= least) if own.constant is None else np.zeros(0, np.int64)
                chars = np.flatnonzero((raw & 0xC0) != 0x80) if len(bad) else raw
                base = np.searchsorted(chars, cuts[:-1])[found.text[bad]] if len(bad) else bad
                begin, end = [np.searchsorted(chars, s[bad]) - base if len(bad) else bad for s in found.spans()] if len(found.first) else (bad, bad)
                listed = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(p[bad], pa.float64())], names=["start", "end", "score"])
                places = pa.array(np.searchsorted(found.text[bad], np.arange(j - i + 1)), pa.int32())
                sizes = pa.array(np.bincount(found.text, minlength=j - i)[: j - i], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.clip(total, 0, 1), pa.float64()), sizes, pa.ListArray.from_arrays(places, listed)], names=["doc_id", "score", "n_sentences", "toxic_sentences"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))
