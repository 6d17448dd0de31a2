"""Operator 12 against counting every phrase, with groups small enough for every kind of prefix."""

from __future__ import annotations

import collections
import random
import re

import pytest

from pulseboard.llm import collocations
from tests.llm import cases


def brute(rows, longest=3, least=10, keep=2000, covered=50):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", cases.lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        cand = {p: x for p, x in c.items() if len(p) > 1 and x >= least}
        hidden = {p[i:j] for p, x in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * x >= covered * c[p[i:j]]}
        scored = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in hidden:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:keep])]
    return sorted(out)


def rows(seed: int = 3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Ärger", "THE", "日本"]
    texts = []
    for k in range(60):
        w = [words[min(int(rng.expovariate(0.15)), 27)] + rng.choice(["", "", "", ".", " ,", "\n", "\t"]) for _ in range(rng.randrange(80))]
        texts.append((" ".join(w), ["en", "de", None][k % 3]))
    texts += [("hot pair " * 400, "en"), ("Hot Pair one hot pair two", "en")] * 3 + [("a-b c-d. " * 12, "und"), ("tie one, two tie; " * 15, "xx")]
    texts += [(None, "en"), ("", None), (" .,;\t", "de"), ("x", "solo"), ("lone " * 5000, "de")]
    return texts + [("copy of this line\n" * 4, "fr")] * 5


@pytest.mark.parametrize("budget, run_words, longest", [(1 << 19, 1 << 20, 3), (64, 100, 3), (8, 1 << 20, 4), (300, 7, 2)])
def test_equals_counting_every_phrase(spark, budget, run_words, longest, monkeypatch):
    monkeypatch.setattr(collocations, "RUN_WORDS", run_words)
    monkeypatch.setattr(collocations, "RUN_BYTES", 600)
    df = spark.createDataFrame([(t, x, "clash", 1) for t, x in rows()], "text string, lang string, `words` string, n int").repartition(3)
    got = collocations.collocations(df, longest=longest, keep=40, budget=budget)
    assert sorted(map(tuple, got.collect())) == brute(rows(), longest, keep=40)


def test_heavy_prefixes_are_cut(spark):
    """A word and a pair that begin most suffixes end up in many groups; no group is far above the budget."""
    texts = [("the cat " + " the cat ".join(f"z{k}" for k in range(2000)), "en")] * 2
    df = spark.createDataFrame(texts, "text string, lang string").select("lang", "text")
    plan = collocations.partition(df, 3, 500)
    assert (plan.one_ways > 0).sum() >= 1 and (plan.two_ways > 0).sum() >= 1 and plan.groups > plan.bounds[1] > plan.bounds[0]
    held = collections.Counter()
    for r in collocations._dealt(df, plan, 3).collect():
        held[r.group] += sum(int.from_bytes(r.counts[i : i + 4], "little") for i in range(0, len(r.counts), 4))
    assert sum(held.values()) == 2 * 6000 and max(held.values()) <= 1000


def test_edge_tables(docs, no_docs, spark):
    same = [(r[1], r[2]) for r in cases.documents()]
    assert sorted(map(tuple, collocations.collocations(docs, least=2).collect())) == brute(same, least=2)
    assert collocations.collocations(no_docs).collect() == []
    nothing = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert collocations.collocations(nothing).collect() == []
