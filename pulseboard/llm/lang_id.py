"""Operator 4: language identification by sparse multinomial logistic regression.

Texts become TF-IDF vectors of hashed character 1- to 3-grams over lower-cased
letters (everything else is a gap). Document frequencies come from all training
documents. The classifier is fitted with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of ``per_language`` labelled training
documents of each language, chosen by a hash of the id at a rate known from the
language's count; a fifth of the sample is kept back to fit the temperature.

At most ``LANGUAGES`` languages are learned, those of the most documents.

A null text, and a text without a letter, is ``und`` with score 0, as is every
text when there is no labelled training document. A null language is never
learned. A null id belongs to the training side. Texts are read whole, a
million characters at a time. Repeated rows give repeated rows; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.shared import keyed_schema, returning, summed_array

#: Hashed features; labelled documents sampled per language; characters per pass.
FEATURES, PER_LANGUAGE, PIECE = 1 << 15, 600, 1 << 20
#: Step size, its offset, elastic-net penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
UND = "und"
#: Languages learned at most: those of the most training documents (ties by name).
LANGUAGES = 256


def _letter_table() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_LETTERS: list[np.ndarray] = []


def gram_counts(text: str | None, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a text's 1- to 3-grams; none if it has no letter."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    table, total, seen = _LETTERS[0], None, False
    text = text or ""
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE].lower()
        cp = np.frombuffer((" " + piece + " ").encode("utf-32-le", "replace"), np.uint32)
        letter = table[cp]
        if not letter.any():
            continue
        seen = True
        x = np.where(letter, cp, np.uint32(32)).astype(np.uint64)
        inner = letter[1:-1] | letter[2:] | letter[:-2]
        one = x[letter]
        two = (x[:-1] << np.uint64(21) | x[1:])[letter[:-1] | letter[1:]]
        three = (x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:])[inner]
        keys = np.concatenate([one, two + np.uint64(1 << 63), three])
        keys = keys * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        found = np.bincount((keys >> np.uint64(40)).astype(np.int64) % size, minlength=size)
        total = found if total is None else total + found
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.flatnonzero(total)
    return where, total[where]


@dataclass
class Model:
    """Weights (features x languages), their inverse document frequencies and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[where]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def probabilities(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((self.vector(where, counts) @ self.weights[where] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        where, counts = gram_counts(text, len(self.idf))
        if not len(where) or not self.languages:
            return UND, 0.0
        p = self.probabilities(where, counts)
        best = int(p.argmax())  # ties: the first language by name
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2 penalties; the last row of the state is the bias, unpenalised."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(where: np.ndarray) -> np.ndarray:
        zs, ns = z[where], n[where]
        l1 = np.where(where == features, 0.0, L1)[:, None]
        l2 = np.where(where == features, 0.0, L2)[:, None]
        w = -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(EPOCHS):
        for where, x, label in rows:
            where, x = np.append(where, features), np.append(x, 1.0)
            w = weights(where)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / ALPHA
            z[where] += g - sigma * w
            n[where] += g * g
    every = weights(np.arange(features + 1))
    return every[:-1], every[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on documents kept out of the fit."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, features: int = FEATURES) -> Model:
    """Learns from ``train`` only; the sample's sparse vectors are what reaches the driver."""
    train = train.select(F.col(doc_id).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null")
    most_rows = train.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    sizes = {r.l: r["count"] for r in most_rows}
    languages = sorted(sizes)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for t in batch.column(0):
            where, _ = gram_counts(t.as_py(), features)
            total[where] += 1
            total[-1] += len(where) > 0

    df = summed_array(train.select("t"), features + 1, add)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    none = Model(languages, idf, np.zeros((features, len(languages))), np.zeros(len(languages)), 1.0)
    if not languages:
        return none

    grid = 1 << 30
    rates = [(name, min(grid, int(grid * per_language / n) + 1)) for name, n in sizes.items()]
    wanted = train.sparkSession.createDataFrame(rates, "l string, wanted long")  # at most LANGUAGES rows
    draw = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(grid))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                where, counts = gram_counts(b.column(2)[i].as_py(), features)
                if len(where):
                    yield pa.RecordBatch.from_pydict({"draw": b.column(0).slice(i, 1), "l": b.column(1).slice(i, 1), "x": pa.array([where.astype(np.int32).tobytes()], pa.binary()), "c": pa.array([counts.astype(np.int32).tobytes()], pa.binary())})

    most = 2 * per_language * len(languages)
    sample = train.join(F.broadcast(wanted), "l").withColumn("draw", draw).where(F.col("draw") < F.col("wanted")).select("draw", "l", "t").mapInArrow(vectors, "draw long, l string, x binary, c binary")
    got = sample.orderBy("draw", "l", F.xxhash64("x", "c")).limit(most).collect()
    rows = [(w := np.frombuffer(r.x, np.int32).astype(np.int64), none.vector(w, np.frombuffer(r.c, np.int32)), languages.index(r.l)) for r in got]
    kept, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    if not kept:
        kept = held
    weights, bias = ftrl(kept, features, len(languages))
    logits = np.array([x @ weights[w] + bias for w, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, calibrated(logits, np.array([y for *_, y in held], np.int64)))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lettered: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; with ``lettered`` also whether the text has a letter,
    which a model without languages does not tell."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            said = [own.predict(t.as_py()) for t in b.column(1)]
            columns, names = [b.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["doc_id", "lang_pred", "score"]
            if lettered:
                has = [s[0] != UND if own.languages else len(gram_counts(t.as_py())[0]) > 0 for s, t in zip(said, b.column(1))]
                columns, names = [*columns, pa.array(has, pa.bool_())], [*names, "lettered"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(doc_id, text).mapInArrow(returning(run), keyed_schema(docs, doc_id, "lang_pred string, score double" + ", lettered boolean" * lettered))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))
