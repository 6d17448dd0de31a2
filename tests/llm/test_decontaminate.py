"""Operator 1 against window-by-window search."""

from __future__ import annotations

import numpy as np
import pytest

from pulseboard.llm import decontaminate
from pulseboard.llm.fm_index import FMIndex
from tests.llm import cases


def brute(text):
    words, hit, items = cases.ascii_words(text), set(), set()
    for item, t in cases.benchmark():
        w = cases.ascii_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            window = w[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    items |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("blocks", [1, 3])
def test_same_hits_as_brute_force(docs, bench, blocks, monkeypatch):
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    got = decontaminate.judged(decontaminate.find_benchmark(docs, bench)).collect()
    assert len(got) == len(cases.documents())
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(r.text)
        for s in r.spans:
            part = r.text.encode()[s.start : s.stop].decode()
            assert len(cases.ascii_words(part)) == s.past - s.first
    assert sum(r.contaminated for r in got) >= 3


def test_empty_tables(docs, no_docs, bench):
    assert decontaminate.find_benchmark(no_docs, bench).count() == 0
    assert decontaminate.judged(decontaminate.find_benchmark(docs, bench.limit(0))).where("n_hit > 0").count() == 0


def test_index_counts_and_locates_like_a_scan():
    rng = np.random.default_rng(3)
    seq = np.concatenate([np.r_[rng.integers(1, 5, 40), 0] for _ in range(30)])
    index = FMIndex(seq, 4)
    phrases = rng.integers(1, 5, (50, 6))
    lengths = rng.integers(1, 7, 50)
    lo, hi = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, lo, hi):
        want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
