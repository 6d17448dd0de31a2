"""Operators 9 and 10 against direct computation."""

from __future__ import annotations

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from pulseboard.llm import context_tree, metric_join
from tests.llm import cases


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for k in range(240):
        v = base[k % 60] + rng.normal(size=16) * (0.02 if k % 3 else 0.35)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(4)]  # copies
    rows += [(310, [2 * x for x in rows[1][1]], 1), (311, rows[0][1], None), (312, None, 0), (313, [0.0] * 16, 0), (314, [None] + rows[0][1][1:], 0)]
    rows += [(315, [float("nan")] * 16, 0), (316, [float("inf")] + [0.0] * 15, 0), (317, rows[0][1][:8], 0), (318, [], 0), (319, [1e30] * 16, 0), (320, [1e-30] * 16, 0)]
    return [*rows, rows[3]]


def brute(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64) / max(map(abs, v))
        return a / np.linalg.norm(a)

    u = [unit(v) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2] and u[a] @ u[b] >= 0.98]
    degree = collections.Counter(itertools.chain(*links))
    root = cases.components(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], degree[k], least[root[k]], least[root[k]] == rows[k][0]) for k in range(len(rows)))


@pytest.mark.parametrize("cell, block", [(2048, 1024), (20, 6)])
def test_range_join_equals_all_pairs(spark, cell, block, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, metric_join.range_join(df).collect())) == brute(vectors())
    assert metric_join.range_join(df.limit(0)).count() == 0


def kt(n0, n1):
    return (n1 + 0.5) / (n0 + n1 + 1)


class Reference:
    """Context-tree weighting with dictionaries, one decision at a time."""

    def __init__(self, texts, nodes):
        grams = collections.Counter()
        for t in texts:
            s = self.symbols(t)
            for i in range(context_tree.DEPTH, len(s)):
                for d in range(context_tree.DEPTH + 1):
                    grams[s[i - d : i], s[i]] += 1
        total = sum(n for (c, _), n in grams.items() if not c)
        self.counts = collections.defaultdict(lambda: [0] * 256)
        for (c, b), n in grams.items():
            self.counts[c][b] += n
        self.kept = {c for c, v in self.counts.items() if sum(v) * nodes >= total}

    @staticmethod
    def symbols(text):
        return b"\n" * context_tree.DEPTH + " ".join(cases.space_words(text)).encode() + b"\n"

    def rest(self, c):
        inner = [k for k in self.kept if len(k) == len(c) + 1 and k[1:] == c]
        return [n - sum(self.counts[k][b] for k in inner) for b, n in enumerate(self.counts[c])], inner

    @staticmethod
    def bits(counts, prefix, level):
        size = 256 >> level
        own = counts[prefix * size : (prefix + 1) * size]
        return sum(own[: size // 2]), sum(own[size // 2 :])

    @staticmethod
    def log_kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(self, c, prefix, level, memo):
        key = (c, prefix, level)
        if key not in memo:
            own = self.log_kt(*self.bits(self.counts[c], prefix, level))
            rest, inner = self.rest(c)
            if inner:
                below = sum(self.weighted(k, prefix, level, memo) for k in inner) + self.log_kt(*self.bits(rest, prefix, level))
                memo[key] = (np.logaddexp(own, below) - math.log(2), own, below)
            else:
                memo[key] = (own, own, None)
        return memo[key][0]

    def chance(self, history, prefix, level, memo):
        p, left, c = 0.0, 1.0, b""
        while True:
            self.weighted(c, prefix, level, memo)
            _, own, below = memo[c, prefix, level]
            here = kt(*self.bits(self.counts[c], prefix, level))
            if below is None:
                return p + left * here
            stay = 1 / (1 + math.exp(min(60, max(-60, below - own))))
            p, left = p + left * stay * here, left * (1 - stay)
            longer = history[len(history) - len(c) - 1 :]
            if longer not in self.kept:
                return p + left * kt(*self.bits(self.rest(c)[0], prefix, level))
            c = longer

    def score(self, text):
        s, memo, total = self.symbols(text), {}, 0.0
        for i in range(context_tree.DEPTH, len(s)):
            for level in range(8):
                one = self.chance(s[i - context_tree.DEPTH : i], s[i] >> (8 - level), level, memo)
                total += math.log10(one if s[i] >> (7 - level) & 1 else 1 - one)
        return total


def test_base_scores_and_rows(spark, docs, no_docs):
    train = docs.where(~context_tree.held_out())
    tokens = lambda t: [*cases.space_words(t), "\n"]
    rows = cases.documents()
    seen = collections.Counter(w for k, t, *_ in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(k), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t, *_ in rows)
    for frequent in (1 << 20, 50):
        got = context_tree.score(docs, train, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    none = context_tree.score(docs, no_docs).collect()
    assert len(none) == len(rows) and all(abs(r.score + r.n_bytes * math.log10(256)) < 1e-3 * r.n_bytes for r in none)
    assert context_tree.score(no_docs, train).count() == 0


@pytest.mark.parametrize("limits", [{}, {"frequent_grams": 8}, {"frequent_grams": 0}])
def test_scores_weight_every_seen_context(spark, monkeypatch, limits):
    monkeypatch.setattr(context_tree, "GRAMS", 20, raising=False)
    filler = "e" * 70_000  # so that each other context is below one in 32,768 bytes
    train = ["a banana and a band", "Ananas  bananas", None, "", "and été", filler]
    test = ["a band of bananas", "zebra", "", None, "été and", "a band of bananas"]
    frame = lambda ts: spark.createDataFrame([(k, t) for k, t in enumerate(ts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.score(frame(test), frame(train), **limits).collect()}
    own = Reference(train, 1 << 40)
    assert len(got) == len(test)
    for k, t in enumerate(test):
        assert abs(got[k] - own.score(t)) < 1e-6


def test_large_counts_are_exact():
    """Counts beyond single precision stay whole up to the depth where groups meet."""
    each = 7_400_003
    key = np.array([k << 40 | 0x414243 << 16 | 0x44 << 8 | (0x40 if k < 20 else 0x41) for k in range(1, 41)], np.int64)
    own = context_tree._Decisions(key, np.full(40, each))
    last = own.x[context_tree.LOCAL] & 0xFF == 0x40 >> 1 | 1 << 7
    assert last.any() and own.zeros[last].sum() == 19 * each and own.ones[last].sum() == 21 * each


def test_code_length_per_byte(spark):
    """Bits a byte are the negative binary logarithm of the text's probability over its bytes; held-out prose is
    coded in fewer than the letters alone would take."""
    train = [cases.prose(k, 300) for k in range(20)]
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = context_tree.score(frame([cases.prose(99, 100), "", "~" * 50]), frame(train)).orderBy("doc_id").collect()
    for r in got:
        assert abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-6 * r.n_bytes
    assert got[0].bits_per_byte < 3 < got[2].bits_per_byte
