"""Small document tables that meet every edge case, and brute-force results for them."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, words array<string>"
WORDS = "river stone cloud table window garden music paper silver morning winter forest bridge candle mirror".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents() -> list[tuple]:
    """Nulls, empty, tiny, long and repeated texts, near copies, benchmark passages, personal data."""
    base = prose(1, 120)
    words = base.split()
    changed = " ".join([*words[:40], "altered", *words[41:]])
    half = " ".join([*words[:60], *prose(9, 60).split()])
    bench = benchmark()
    texts = {
        0: base, 1: base.upper(), 2: changed, 3: half, 4: None, 5: "", 6: " \n\t", 7: "One two", 8: "one  two",
        9: "!!! 123 ???", 10: prose(2, 8000), 11: f"{prose(3, 30)} {bench[0][1]} {prose(4, 30)}",
        12: f"{prose(5, 900)} {bench[1][1]}", 13: bench[2][1].upper(), 14: "short Item",
        15: "Ring +1 (499) 555-6503 10.1.2.3 or a.b+c@mail.example.com, card 4111 1111 1111 1111 no 4111111111111112.",
        16: "x@y a@b.c 1.2.3.4.5 300.1.1.1 +12 +123456789 4111111111111111 5500005555555559",
        17: "Äpfel straße don't WE'LL <|endoftext|> 日本語 ΑΣ ﬁ é́ ½", 18: "a" * 5000, 20: "DE LA " + prose(6, 50),
    }
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t) if t is not None else None, "clash", ["w"]) for k, t in texts.items()]
    rows += [rows[0], (None, "no id here " + base, "en", None, 5, None, None), (None, None, None, None, None, None, None)]
    return rows


def benchmark() -> list[tuple]:
    items = [(k, prose(100 + k, 30)) for k in range(3)]
    return [*items, (3, "short item"), (4, None), (5, " .. "), (6, items[0][1]), (None, prose(104, 20)), (20, items[1][1])]


def ascii_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingles(text: str | None) -> frozenset:
    w = space_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(n: int, links) -> list[int]:
    """The least reachable number of each of n vertices."""
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root
