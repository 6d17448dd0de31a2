"""Byte-pair merging of many distinct words at once, from a public vocabulary file.

``BytePairs`` reads a tokenizer's JSON file (its path is a parameter) and merges
a whole batch of words with numpy: every round finds the lowest-ranked pair of
each word and merges all its occurrences, left to right.
"""

from __future__ import annotations

import json

import numpy as np


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes follow
    in order from code point 256.
    """
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    names = {b: chr(b) for b in kept}
    return [names.get(b) or chr(next(other)) for b in range(256)]


class BytePairs:
    """Exact byte-pair encoding of byte words; ``end`` is the mark of a word's last symbol ("" if none)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        #: Merges by pair, their ranks, and the tokens made, by rank.
        self._keys, self._order, self._made = keys[order], order, made
        self._none = len(keys)
        grid = np.repeat(self.first, 256), np.tile(self.first, 256), np.tile(self.last, 256)
        every = np.arange(1 << 16)
        self._byte_pairs = self._ranks(np.stack(grid[:2], 1).ravel(), np.repeat(every, 2), every * 2)
        self._byte_last = self._ranks(np.stack(grid[::2], 1).ravel(), np.repeat(every, 2), every * 2)
        back = {s: b for b, s in enumerate(symbols)}
        top = max([*self.vocab.values(), *self.specials.values()]) + 1
        #: The bytes of every token id, for decoding.
        self.token_bytes: list[bytes] = [b""] * top
        for s, i in self.vocab.items():
            if s in self.specials:
                continue
            body = s[: -len(self.end)] if self.end and s.endswith(self.end) and len(s) > len(self.end) else s
            self.token_bytes[i] = bytes(back[c] for c in body) if all(c in back for c in body) else s.encode()
        for s, i in self.specials.items():
            self.token_bytes[i] = s.encode()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the n+1 offsets of the words.

        Empty words have no ids. Bounded by the words given: callers pass
        distinct words of one batch, a very long word among them or not.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ends = np.cumsum(lengths)
        final = np.zeros(n, bool)
        final[ends[lengths > 0] - 1] = True
        ids = np.where(final, self.last[data], self.first[data])
        # What each symbol makes with the next one of its word: first from tables of byte pairs.
        made = np.full(n, -1, np.int64)
        pair = data[:-1].astype(np.int64) << 8 | data[1:]
        made[:-1] = np.where(final[1:], self._byte_last[pair], self._byte_pairs[pair])
        made[:-1][final[:-1]] = -1
        out = np.full(n, -1, np.int64)
        word, at = np.repeat(np.arange(len(words)), lengths), np.arange(n)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[:-1] != word[1:]])
            sizes = np.diff(np.r_[starts, len(ids)])
            rank = np.where(made >= 0, made, self._none)
            best = np.minimum.reduceat(rank, starts)
            over = best == self._none
            if over.any():
                ended = np.repeat(over, sizes)
                out[at[ended]] = ids[ended]
                ids, word, at, rank = ids[~ended], word[~ended], at[~ended], rank[~ended]
                best, sizes = best[~over], sizes[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, sizes)
            # Of overlapping hits (a run of one symbol) every second one merges.
            twice = hit[1:] & hit[:-1]
            if twice.any():
                place = np.arange(len(hit))
                head = hit & ~np.r_[False, hit[:-1]]
                hit &= (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
            where = np.flatnonzero(hit)
            ids[where] = self._made[rank[where]]
            rank[where] = -1  # to be looked up anew, as is the pair that ends in a merged symbol
            rank[where[where > 0] - 1] = -1
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            ids, word, at, made = ids[keep], word[keep], at[keep], rank[keep]
            new = np.flatnonzero(made < 0)
            made[made == self._none] = -1
            made[new] = self._ranks(ids, word, new)
        flat = out >= 0
        return out[flat], np.r_[0, np.cumsum(flat)[ends - 1] * (ends > 0)] if len(words) else np.zeros(1, np.int64)

    def _ranks(self, ids: np.ndarray, word: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at ``where``; -1 for none."""
        out = np.full(len(where), -1, np.int64)
        inner = np.flatnonzero(where + 1 < len(ids))
        inner = inner[word[where[inner]] == word[where[inner] + 1]]
        p = where[inner]
        keys = ids[p] << 32 | ids[p + 1]
        spot = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        out[inner] = np.where(self._keys[spot] == keys, self._order[spot], -1)
        return out
