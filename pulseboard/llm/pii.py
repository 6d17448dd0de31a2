"""Operator 5: personal data by candidate gradient boosting.

*Base spans* come from four fixed patterns with checks (address shape, parts up
to 255, Luhn sum, digit counts); a match that fails its check is dropped whole.
*Candidates*: high-recall generators propose overlapping spans, among them the
pieces of matches that failed as a whole (a phone number that ran into an
address, two card numbers side by side) and spellings that no pattern takes.
*Boosted trees* score each candidate by its format and its surroundings. They
learn from the candidates of all documents, without labels from outside: spans
of the base are positive; candidates that fail a check of their kind, or cross a
base span, are negative; the rest is left unlabelled and is what they decide.
Trees see each feature by its bin between quantiles of all of them, so Spark
counts the candidates of equal bins, and those counts are what they are fitted on.
*Thresholds*: probabilities are calibrated on the texts kept out, a quarter by a
hash, and each kind's threshold is the least that reaches ``PRECISION`` there.
Spans above it that cross no chosen one are added; base spans always stay.

Offsets are code points, the end exclusive. Null text has no spans. Texts are
read whole, in time linear in their length. Repeated rows give repeated rows;
extra columns are left out. With no labelled candidate of both sorts the base
alone is returned.
"""

from __future__ import annotations

import collections
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.boosted_trees import BINS, Boosted
from pulseboard.llm.shared import dropped, keyed_schema, returning, stored

KINDS = ("email", "ip", "card", "phone")
#: Features of a candidate; precision asked for; distinct candidates that a task counts at once.
FEATURES, PRECISION, COUNTED = 22, 0.98, 1 << 14

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_HOST = re.compile(r"[A-Za-z0-9.-]+")
#: The contract's patterns; a number starts where no digit is before it, which finds the same matches in linear time.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){4,}+")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}")
_NUMBER = re.compile(r"[0-9]+")
Span = tuple[int, int, int]  # start, kind's number, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def valid(kind: int, body: str) -> bool:
    """The check that a match of this kind must pass."""
    if kind == 0:
        return True
    if kind == 1:
        return all(map(small_part, body.split(".")))
    digits = _digits(body)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)
    return out


def base_matches(text: str) -> list[Span]:
    """All matches of the four patterns, checked or not."""
    out = _emails(text) if "@" in text else []
    for kind, pattern in ((1, _IP), (2, _CARD)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)]
    return out


def _windows(text: str, start: int, end: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole numbers within [start, end) of together ``least`` to ``most`` digits."""
    numbers = [m.span() for m in _NUMBER.finditer(text, start, end)]
    for i, (a, _) in enumerate(numbers):
        n = 0
        for b, c in numbers[i:]:
            n += c - b
            if n > most:
                break
            if n >= least:
                yield a, c


def generate(text: str, matches: list[Span]) -> set[Span]:
    """Overlapping candidates: the matches, their pieces, and looser spellings."""
    out = set()
    for start, kind, end in matches:
        n = end - start
        if kind == 0:
            out.add((start, 0, end))
            inner = start + n - len(text[start:end].lstrip("._%+-"))
            out.add((inner, 0, start + len(text[start:end].rstrip("-"))))
            at = text.index("@", start)
            out.add((at + 1, 0, end))
        elif kind == 1:
            out.add((start, 1, end))
        elif kind == 2 and n >= 9:
            if n <= 40:  # 19 digits and the separators between them take fewer characters
                out.add((start, 2, end))
            out.update((a, 2, b) for a, b in _windows(text, start, end, 12, 19))
        elif kind == 3:
            out.add((start, 3, end))
            digits = 0
            for m in _NUMBER.finditer(text, start, end):
                digits += m.end() - m.start()
                if digits > 15:
                    break
                if digits >= 9:
                    out.add((start, 3, m.end()))
    out.update((a, 1, b) for m in _DOTTED.finditer(text) for a, b in _quads(text, *m.span()))
    if "(" in text or "[" in text:
        out.update((m.start(), 0, m.end()) for m in _SPELT.finditer(text))
    out.update((m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text))
    return {s for s in out if s[0] < s[2]}


def _quads(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    numbers = [m.span() for m in _NUMBER.finditer(text, start, end)]
    for i in range(len(numbers) - 3):
        yield numbers[i][0], numbers[i + 3][1]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and of what surrounds it."""
    start, kind, end = span
    body = text[start : min(end, start + 400)]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    numbers = _NUMBER.findall(body)
    digits = "".join(numbers)
    near = lambda s: float(bool(s) and s.isalnum())
    p, q = before[-1:], after[:1]
    return [
        float(kind), float(end - start), float(len(digits)), float(len(numbers)),
        float(luhn(digits[:40])), float(body[:1] == "+"), float(sum(body.count(c) for c in "()")), float(body.count(".")), float(body.count("-")), float(body.count(" ")), float("@" in body),
        float(max(map(len, numbers), default=0)), float(min(map(len, numbers), default=0)), float(all(map(small_part, numbers))),
        near(p), near(q), float(p in ".-+@" and p != ""), float(q in ".-+@" and q != "" and near(after[1:2])),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)), float(body[:1].isalnum()), float(len(body.rpartition(".")[2])),
    ]


def base_spans(text: str, matches: list[Span]) -> list[Span]:
    return sorted(s for s in matches if valid(s[1], text[s[0] : s[2]]))


def _crosses(span: Span, chosen: list[Span]) -> bool:
    """``chosen`` is sorted and disjoint within what matters: neighbours of the place are looked at."""
    at = bisect_left(chosen, (span[0], -1, -1))
    return any(s[0] < span[2] and span[0] < s[2] for s in chosen[max(0, at - 4) : at + 4])


def proposals(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the sorted candidates that are not one of them."""
    matches = base_matches(text)
    base = base_spans(text, matches)
    if not matches and "(" not in text and "[" not in text:
        return base, []
    return base, sorted(generate(text, matches) - set(base))


def labelled(text: str) -> tuple[list[list[float]], list[int], list[int]]:
    """Features, labels and kinds of the candidates whose label is certain."""
    base, others = proposals(text)
    rows = [(s, 1) for s in base] + [(s, 0) for s in others if not valid(s[1], text[s[0] : s[2]]) or _crosses(s, base)]
    return [features(text, s) for s, _ in rows], [y for _, y in rows], [s[1] for s, _ in rows]


@dataclass
class Model:
    trees: Boosted | None
    thresholds: dict[int, float]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans of a text, by start and then kind."""
        if not text:
            return [], []
        base, others = proposals(text)
        if self.trees is None:
            return base, base
        open_ = [s for s in others if valid(s[1], text[s[0] : s[2]]) and not _crosses(s, base)]
        if not open_:
            return base, base
        p = self.trees.probability(np.array([features(text, s) for s in open_]))
        chosen = list(base)
        for k in sorted(range(len(open_)), key=lambda k: (-round(p[k], 6), open_[k][0] - open_[k][2], open_[k])):
            if p[k] >= self.thresholds.get(open_[k][1], 2.0) and not _crosses(open_[k], chosen):
                chosen.insert(bisect_left(chosen, open_[k]), open_[k])
        return base, sorted(chosen)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kept_out, kind, y, x, n): the labelled candidates of all texts, counted in the tasks as far as they are equal."""
    has = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9]{3}|@|\\+[0-9]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter = collections.Counter()

        def rows() -> pa.RecordBatch:
            out, kind, y, x = zip(*seen)
            columns = [pa.array(out), pa.array(kind, pa.int32()), pa.array(y, pa.int32()), pa.array([list(v) for v in x], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["kept_out", "kind", "y", "x", "n"])

        for b in batches:
            for out, t in zip(b.column(0).to_pylist(), b.column(1)):
                for x, y, kind in zip(*labelled(t.as_py())):
                    seen[out, kind, y, tuple(x)] += 1
                if len(seen) > COUNTED:
                    yield rows()
        if seen:
            yield rows()

    # By the text alone, so copies of one text are on one side.
    kept_out = (F.pmod(F.xxhash64("t", F.lit(5)), F.lit(4)) == 0).alias("kept_out")
    return has.select(kept_out, "t").mapInArrow(returning(run), "kept_out boolean, kind int, y int, x array<double>, n long")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learns from all texts; what reaches the driver is a count for each combination of bins that occurs."""
    rows = stored(counted(docs, text), "candidates")
    points = F.lit([float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]])
    cuts = rows.where("not kept_out").agg(*[F.percentile(F.col("x")[k], points, F.col("n")).alias(f"c{k}") for k in range(FEATURES)]).first()
    if cuts is None or cuts.c0 is None:
        dropped(rows)
        return Model(None, {})
    cuts = [np.unique(c) for c in cuts]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(3).flatten().to_numpy().reshape(-1, FEATURES)
                bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v.tobytes() for v in bins], pa.binary()), b.column(4)], names=["kept_out", "kind", "y", "bins", "n"])

    keys = ["kept_out", "kind", "y", "bins"]
    groups = rows.mapInArrow(binned, "kept_out boolean, kind int, y int, bins binary, n long").groupBy(*keys).agg(F.sum("n").alias("n"))
    got = sorted(groups.collect(), key=lambda r: tuple(r[k] for k in keys))
    dropped(rows)
    bins = np.frombuffer(b"".join(bytes(r.bins) for r in got), np.uint8).reshape(-1, FEATURES)
    # A bin stands for the cut that ends it, which is on the same side of every cut as the bin's values.
    x = np.stack([np.append(c, c[-1] + 1)[v] for c, v in zip(cuts, bins.T)], 1)
    y, kinds, fold = (np.array([r[k] for r in got]) for k in ("y", "kind", "kept_out"))
    n = np.array([r.n for r in got], float)
    many = lambda rows: n[rows].sum()
    if min(many(~fold & (y == 1)), many(~fold & (y == 0))) < 10 or min(many(fold & (y == 1)), many(fold & (y == 0))) < 3:
        return Model(None, {})
    trees = Boosted.fit(x[~fold], y[~fold].astype(float), n[~fold], cuts)
    trees.calibrate(x[fold], y[fold].astype(float), n[fold])
    p = trees.probability(x)
    thresholds = {}
    for kind in range(len(KINDS)):
        own = fold & (kinds == kind)
        for t in np.round(np.linspace(0.5, 0.99, 50), 2):
            picked = own & (p >= t)
            if picked.any() and many(picked & (y == 1)) >= PRECISION * many(picked):
                thresholds[kind] = float(t)
                break
    return Model(trees, thresholds)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every merged run of spans replaced by the kind of its first."""
    if not text or not spans:
        return text
    out, past = [], 0
    for start, kind, end in spans:
        if start >= past:
            out += [text[past:start], f"[{KINDS[kind].upper()}]"]
        past = max(past, end)
    return "".join([*out, text[past:]])


def find_personal(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans, redacted): spans as arrays of structs (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        shown = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for b in batches:
            base, every, clean = [], [], []
            for t in b.column(1).to_pylist():
                x, y = own.spans(t)
                base.append(shown(x))
                every.append(shown(y))
                clean.append(redacted(t, y))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(every, span), pa.array(clean, pa.string())], names=["doc_id", "base", "spans", "redacted"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(doc_id, text).mapInArrow(returning(run), keyed_schema(docs, doc_id, f"base {kind}, spans {kind}, redacted string"))
