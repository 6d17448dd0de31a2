"""Operator 3 against the comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseboard.llm import jaccard_join
from tests.llm import cases


def brute(rows):
    sets = [cases.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = cases.components(len(rows), links)
    named = {}
    for k, r in enumerate(root):
        named.setdefault(r, []).append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in named.items()}
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted([(i, len(s), least[root[k]] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))], key=key)


def run(df):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted([tuple(r) for r in jaccard_join.near_duplicates(df).collect()], key=key)


def test_edge_cases(docs, no_docs):
    assert run(docs) == brute([r[:2] for r in cases.documents()])
    assert run(no_docs) == []


@pytest.mark.parametrize("many", [64, 0])
def test_groups_chains_and_shared_passages(spark, many, monkeypatch):
    """A group of near copies, a chain whose ends do not link, short texts about one passage, and
    sub-regions; with ``many`` 0 every region is entered again before its last pairs are compared."""
    monkeypatch.setattr(jaccard_join, "MANY", many)
    monkeypatch.setattr(jaccard_join, "SUB_REGION", 3)
    rng, rows = random.Random(7), []
    base = cases.prose(50, 90).split()
    for k in range(12):
        copy = list(base)
        copy[rng.randrange(90)] = f"new{k}"
        rows.append((k, " ".join(copy)))
    step = cases.prose(51, 100).split()
    for k in range(8):
        step[12 * k % 100] = f"step{k}"
        rows.append((100 + k, " ".join(step)))
    passage = cases.prose(52, 55)
    rows += [(200 + k, f"{cases.prose(60 + k, rng.randrange(3, 30))} {passage}") for k in range(14)]
    rows += [(300 + k, cases.prose(90, 40)) for k in range(5)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows)


def test_a_group_of_near_copies_is_not_held_against_itself(spark, monkeypatch):
    """Where most members link to a few others each, the pairs compared follow the members, not their square."""
    monkeypatch.setattr(jaccard_join, "MANY", 0)
    compared, distances = [], jaccard_join._distances

    def counted(docs, pairs, *rest):
        compared.append(pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        return distances(docs, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_distances", counted)
    rng, base, rows = random.Random(8), cases.prose(53, 150).split(), []
    for k in range(500):
        copy = list(base)
        for at in rng.sample(range(10), 4):
            copy[15 * at + rng.randrange(3)] = f"new{k}at{at}"
        rows.append((k, " ".join(copy)))
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows)
    assert compared[-1] < 2 * len(rows), compared


def test_parity_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 180), (700, 500)):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 62, m).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert jaccard_join.parity_distance(jaccard_join.parity(a), jaccard_join.parity(b)) <= apart
        assert np.bitwise_count((jaccard_join.short_parity(a) ^ jaccard_join.short_parity(b)).view(np.uint64)).sum() <= apart
        assert jaccard_join.parity_distance(jaccard_join.parity(a), jaccard_join.parity(a)) == 0


def test_kept_distances_bound_the_true_ones(spark):
    rng = random.Random(3)
    base = cases.prose(95, 80).split()
    texts = [" ".join(w if rng.random() > k / 1000 else f"x{k}" for w in base) for k in range(30)] + [cases.prose(96 + k, 60) for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard_join.classes(docs).where("n > 0").dropDuplicates(["class"])
    own = {r["class"]: cases.shingles(texts[r.doc_id]) for r in rows.collect()}
    sketches = rows.select("class", "n", "sketch")
    x, y = sketches.alias("x"), sketches.alias("y")
    pairs = x.join(y, F.col("x.class") < F.col("y.class")).select(F.col("x.class").alias("a"), F.col("x.n").alias("an"), F.col("y.class").alias("b"), F.col("y.n").alias("bn"))
    got = jaccard_join._distances(docs, pairs, sketches, "text", 75).collect()
    exact = 0
    for r in got:
        a, b = own[r.a], own[r.b]
        true = 1 - len(a & b) / len(a | b)
        assert r.low <= true * jaccard_join.SCALE + 1e-6 and r.high >= true * jaccard_join.SCALE - 1e-6
        assert r.linked == (100 * len(a & b) >= 75 * len(a | b))
        exact += r.high - r.low <= 1
    assert len(got) > 150 and exact > 30


def test_later_links_join_components(spark):
    parts = spark.createDataFrame([(2, 2), (5, 2), (7, 7), (9, 7)], "id long, root long")
    links = spark.createDataFrame([(9, 5), (11, 20), (20, 30)], "a long, b long")
    got = {r.id: r.root for r in jaccard_join._joined(parts, links).collect()}
    assert got == {2: 2, 5: 2, 7: 2, 9: 2, 11: 11, 20: 11, 30: 11}
    assert jaccard_join._joined(parts, links.limit(0)) is parts
