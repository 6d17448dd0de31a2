"""Operator 13: bags and scores against plain code, the gradient, planted documents and held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseboard.llm import toxicity
from pulseboard.llm.queries import op13_toxicity
from pulseboard.llm.shared import hash_words, mixed
from tests.conftest import SF01
from tests.llm import cases


def plain_bags(text):
    """[(start, end, set of features)] of a text's sentences, by regular expressions."""
    out = []
    for m in re.finditer(r"[^.!?\n\r]+", cases.lowered(text)):
        words = [(w.start(), w.end(), w.group()) for w in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", m.group())]
        for k in range(0, len(words), toxicity.SENTENCE):
            part = words[k : k + toxicity.SENTENCE]
            whole = hash_words([w.encode() for *_, w in part])
            stems = hash_words([w[:n].encode() for *_, w in part for n in toxicity.STEMS if len(w) > n])
            both = np.concatenate([whole, mixed(stems + np.uint64(1)) if len(stems) else stems]) % np.uint64(toxicity.FEATURES)
            out.append((m.start() + part[0][0], m.start() + part[-1][1], {int(x) for x in both}))
    return out


def planted():
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(500):
        lines = [" ".join(rng.choice(cases.WORDS) + rng.choice("abcde") for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 12))]
        bad = k % 8 == 0
        if bad:
            lines.insert(rng.randrange(len(lines) + 1), f"Bridge {rng.choice(['Grumph', 'vilest', 'grumphed'])} window")
        rows.append((k, ". ".join(lines) + rng.choice(["", "!", "?\n"])))
        labels.append((k, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = planted()
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.fit(docs, given.where(~toxicity.held_out()))


def test_planted_sentences_are_found_and_located(spark, model):
    rows, labels = planted()
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for (k, text), (_, bad) in zip(rows, labels):
        assert (got[k].score >= 0.3) == bool(bad)
        places = [text[s.start : s.end].lower() for s in got[k].toxic_sentences]
        assert len(places) == bad and all("grumph" in p or "vilest" in p for p in places)


@pytest.mark.parametrize("sentence, block, stop", [(1000, 1 << 18, 1 << 21), (5, 20, 300)])
def test_scores_equal_a_plain_noisy_or(docs, model, monkeypatch, sentence, block, stop):
    monkeypatch.setattr(toxicity, "SENTENCE", sentence)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(1)
    own = toxicity.Model(np.where(rng.random(toxicity.FEATURES) < 0.2, rng.normal(size=toxicity.FEATURES) * 2, 0).astype(np.float32), -5.0, -4.0)
    texts = [r[1] for r in cases.documents()]
    data = "".join(t or "" for t in texts).encode()
    offsets = np.cumsum([0, *[len((t or "").encode()) for t in texts]])
    found = toxicity.bags(np.frombuffer(data, np.uint8), offsets)
    p = own.sentences(found)
    total = own.documents(found, p, len(texts))
    at = 0
    for t, got in zip(texts, total):
        clear = 1 - 1 / (1 + math.exp(4))
        for *_, features in plain_bags(t or ""):
            z = -5 + sum(float(own.weights[f]) for f in features)
            assert abs(p[at] - 1 / (1 + math.exp(-z))) < 1e-9
            clear *= 1 - 1 / (1 + math.exp(-z))
            at += 1
        assert abs(got - (1 - clear)) < 1e-9
    assert at == len(p)


def test_spans_are_code_points(spark, model):
    texts = [r[1] for r in cases.documents()] + ["ä. Ö grumph 日本! ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in toxicity.score(df, model, least=0.0).collect():
        assert [(s.start, s.end) for s in r.toxic_sentences] == [x[:2] for x in plain_bags(texts[r.doc_id])]
        assert r.n_sentences == len(r.toxic_sentences)


def test_gradient_of_the_noisy_or(monkeypatch):
    """One step from zero moves every coordinate against the numeric slope of the log loss."""
    rng = np.random.default_rng(2)
    for name, value in (("EPOCHS", 1), ("L1", 0.0), ("L2", 0.0)):
        monkeypatch.setattr(toxicity, name, value)
    feature, sentence = np.array([0, 1, 2, 0, 3]), np.array([0, 0, 1, 1, 2])

    def loss(w, y):
        z = np.array([w[0] + w[1], w[2] + w[0], w[3]]) + w[4] + toxicity.BIAS
        clear = np.prod(1 - 1 / (1 + np.exp(-z))) * (1 - 1 / (1 + np.exp(-(w[5] + toxicity.LEAK))))
        return -math.log(1 - clear if y else clear)

    for y in (0, 1):
        own = toxicity.learn([(feature, sentence, y, 1.0)], 4)
        moved = np.array([*own.weights, own.bias - toxicity.BIAS, own.leak - toxicity.LEAK])
        slope = [(loss(np.eye(6)[k] * 1e-5, y) - loss(np.eye(6)[k] * -1e-5, y)) / 2e-5 for k in range(6)]
        step = [-toxicity.ALPHA * g / (toxicity.BETA + abs(g)) for g in slope]
        assert np.allclose(moved, step, atol=1e-4)


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = op13_toxicity(spark, SF01).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    caught = [r.score for r in held if r.toxic == 1]
    clean = [r.score for r in held if r.toxic == 0]
    above = sum((a > b) + (a == b) / 2 for a in caught for b in clean) / (len(caught) * len(clean))
    assert above > 0.8 and sum(s >= 0.3 for s in clean) <= 0.03 * len(clean)


def test_a_rare_class_is_learnt_among_the_other(spark):
    """Where the classes are sampled at different rates, their rows still come mixed (F1)."""
    rng = random.Random(5)
    rows = []
    for k in range(4000):
        lines = [" ".join(rng.choice(cases.WORDS) + rng.choice("abcde") for _ in range(8)) for _ in range(30)]
        if k % 10 == 0:
            lines[rng.randrange(30)] += " grumph" if k % 20 else " vilest"
        rows.append((k, ". ".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    given = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(4000)], "doc_id long, toxic int")
    own = toxicity.fit(df, given.where(~toxicity.held_out()), per_class=280)
    got = toxicity.score(df.where(toxicity.held_out()), own).collect()
    caught, clean = ([r.score for r in got if (r.doc_id % 10 == 0) == bad] for bad in (True, False))
    assert min(caught) > max(clean) and max(clean) < 0.3
    assert sum(s >= 0.3 for s in caught) > 0.9 * len(caught)


def test_edge_cases(docs, no_docs, spark, model):
    leak = 1 / (1 + math.exp(-model.leak))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(cases.documents())
    assert all(abs(r.score - leak) < 1e-12 and r.n_sentences == 0 for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    alone = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, alone).collect()} == {1.0}  # every label says toxic
    nothing = toxicity.fit(no_docs, labels.limit(0))
    assert {(r.score, len(r.toxic_sentences)) for r in toxicity.score(docs, nothing).collect()} == {(0.0, 0)}
    mixed_labels = spark.createDataFrame([(0, 1), (10, 0), (3, 0)], "doc_id long, toxic int")
    tiny = toxicity.fit(docs, mixed_labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, tiny).collect())
    assert toxicity.fit(no_docs, mixed_labels).constant == pytest.approx(1 / 3)
    assert docs.where(toxicity.held_out()).where(F.col("doc_id").isNull()).count() == 0
