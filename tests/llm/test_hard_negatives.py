"""Operator 11 against all pairs, and its coordinate ranges against exact scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseboard.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, x int, score string"


def rows(n: int = 300, dims: int = 12):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, dims))
    out = []
    for k in range(n):
        v = centres[k % 6] + rng.normal(size=dims) * 0.6
        v = v / np.linalg.norm(v) * rng.choice([1.0, 1.0, 0.3, 5.0])
        out.append((k, [float(x) for x in v], int(rng.integers(4))))
    out += [(400 + k, out[0][1], 1 + k % 2) for k in range(30)]  # one vector many times
    out += [(500, None, 1), (501, [0.0] * dims, 1), (502, [None] + out[0][1][1:], 1), (503, [math.nan] * dims, 1), (504, out[1][1], None)]
    out += [(510, out[2][1][:5], 1), (511, out[3][1][:5], 2), (512, out[4][1][:5], 1), (520, [], 1), (521, [], 2), (522, [], 1), (530, [1e300] * dims, 1), (None, out[5][1], 0)]
    out += [out[7], out[7], (30, out[8][1], 3), (30, out[9][1], out[30][2])]  # a repeated row, an id with other vectors
    return [(*r, 1, "s") for r in out]


def brute(given, positives=5, negatives=10, band=(30, 90), scale=256):
    sound = {(k, label, tuple(math.floor(scale * x) for x in v)) for k, v, label, *_ in given if None not in (k, label, v) and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)}
    out = []
    for a, label, x in sound:
        if a % 10:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), b, other == label) for b, other, y in sound if b != a and len(y) == len(x)]
        for s, b, _ in sorted(r for r in scores if r[2])[:positives]:
            fits = sorted(r for r in scores if not r[2] and band[0] * -s <= -100 * r[0] <= band[1] * -s)[:negatives]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("bucket, part, anchors, sample", [(4096, 1 << 14, 2048, 4096), (16, 60, 7, 20), (1, 40, 2048, 0)])
def test_equals_all_pairs(spark, bucket, part, anchors, sample, monkeypatch):
    for name, value in (("BUCKET", bucket), ("PART", part), ("ANCHORS", anchors), ("SAMPLE", sample)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows())


def test_other_parameters_and_empty_tables(spark):
    df = spark.createDataFrame(rows(80), SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, scale=1000, positives=2, negatives=3, band=(-50, 120))
    assert sorted(map(tuple, got.collect())) == brute(rows(80), 2, 3, (-50, 120), 1000)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") < 0).collect() == []


def test_ranges_hold_every_row_that_scores_enough_and_rule_out_others():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(950, 1000, size=(2000, 1))).astype(np.int64)
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    unit = x / norm[:, None]
    bucket = hard_negatives.Bucket(np.arange(len(x)), np.zeros(len(x), np.int64), x, float(norm.max()), np.argsort(unit, axis=0).T, unit)
    seen, ruled_out, kept = 0, 0, 0
    for a in range(200):
        scores = x @ x[a]
        for least in [-5.0, float(np.median(scores)), *(share * scores.max() for share in (0.5, 0.8, 0.9, 0.95, 1.0, 2.0))]:
            rows = bucket.candidates(unit[a], norm[a], least)
            if rows is None:
                continue
            assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            seen += 1
            ruled_out += len(x) - len(rows)
            kept += len(rows)
    assert seen > 200 and kept and ruled_out / seen > 0.8 * len(x)


def test_scores_beyond_double_precision_are_exact():
    a = np.array([[(1 << 29) + 1, -(1 << 29) + 3]], np.int64)
    assert hard_negatives.exact_scores(a, a)[0, 0] == sum(int(v) ** 2 for v in a[0])
