"""A minimal acyclic transducer: frequent words to token ids, in flat arrays.

States share suffixes (Daciuk's incremental construction over sorted words);
every arc carries the number of accepted words that come before it, so the sum
along a word's path is its place among the sorted words, and that place indexes
the ids. The compiled form is five arrays in one buffer that workers map.
"""

from __future__ import annotations

import numpy as np


class Transducer:
    """Looks up many words at once, one byte of all of them a step."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arcs, self.target, self.skipped, self.final, self.starts, self.ids = (arrays[k] for k in ("arcs", "target", "skipped", "final", "starts", "ids"))

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, starts: np.ndarray) -> Transducer:
        """``words`` sorted and distinct; ids of word k are ``ids[starts[k]:starts[k+1]]``."""
        registry: dict[tuple, int] = {}
        done: list[tuple[bool, tuple]] = []

        def sealed(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(done)
                done.append(key)
            return registry[key]

        path: list[list] = [[False, []]]  # open states: final, arcs (byte, state)
        before = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = sealed(path.pop())
                path[-1][1].append((before[len(path) - 1], state))

        for w in words:
            n = 0
            while n < min(len(w), len(before)) and w[n] == before[n]:
                n += 1
            close(n)
            path.extend([False, []] for _ in w[n:])
            path[len(w)][0] = True
            before = w
        close(0)
        root = sealed(path[0])
        accepted = np.zeros(len(done), np.int64)  # words accepted from a state; targets come first
        arcs, target, skipped = [], [], []
        final = np.array([f for f, _ in done], bool)
        for s, (f, out) in enumerate(done):
            seen = int(f)
            for byte, t in out:
                arcs.append(s << 8 | byte)
                target.append(t)
                skipped.append(seen)
                seen += accepted[t]
            accepted[s] = seen
        order = np.argsort(np.array(arcs, np.int64), kind="stable")
        own = cls({"arcs": np.array(arcs, np.int64)[order], "target": np.array(target, np.int64)[order], "skipped": np.array(skipped, np.int64)[order], "final": final, "starts": np.asarray(starts, np.int64), "ids": np.asarray(ids, np.int64)})
        assert root == len(done) - 1
        return own

    def dump(self) -> bytes:
        """A header of six lengths, then the arrays as 64-bit integers."""
        arrays = [self.arcs, self.target, self.skipped, self.final, self.starts, self.ids]
        return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.astype(np.int64).tobytes() for a in arrays)])

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        whole = np.asarray(np.memmap(path, np.int64, "r"))  # still the mapped pages
        ends = np.cumsum(np.r_[6, whole[:6]])
        parts = dict(zip(("arcs", "target", "skipped", "final", "starts", "ids"), (whole[a:b] for a, b in zip(ends[:-1], ends[1:]))))
        return cls(parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the compiled ones; -1 if it is not one."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.arcs) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at = np.cumsum(lengths) - lengths
        state = np.full(len(words), len(self.final) - 1, np.int64)
        place = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            keys = state[live] << 8 | data[at[live] + step]
            spot = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            ok = self.arcs[spot] == keys
            live, spot = live[ok], spot[ok]
            state[live] = self.target[spot]
            place[live] += self.skipped[spot]
            step += 1
            over = lengths[live] == step
            ended = live[over]
            ended = ended[self.final[state[ended]] != 0]
            out[ended] = place[ended]
            live = live[~over]
        return out
