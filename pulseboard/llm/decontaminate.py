"""Operator 1: benchmark decontamination with one FM-index per training shard.

A shard is a few megabytes of texts. Its words become numbers of the
benchmark's vocabulary; a word that no item has can be in no window, so it only
separates, and a run shorter than the shortest window is left out of the index.
All windows are searched backwards together, their occurrences are located from
sampled suffix positions, and overlapping hits merge into spans to remove.

Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII
characters. A window is ``width`` consecutive item words, or a shorter item
whole. Null or wordless texts have no words, windows or hits; a null item id is
searched for but not listed. Repeated items share their windows, repeated
documents are judged each. Empty tables give empty results or no hits. Extra
columns of either table are left out. A long text is searched whole.

The benchmark reaches the tasks in blocks of about ``BLOCK_BYTES``, each one a
pass over the documents' stream, so no broadcast grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.fm_index import FMIndex
from pulseboard.llm.shared import ALNUM, LOWER, column_bytes, hash_words, keyed_schema, returning, slices, span_hashes, word_bounds

WIDTH = 13
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20


class Windows:
    """The distinct windows of some benchmark items, and the items that have them."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
            raw = data.tobytes()
            own = [vocabulary.setdefault(raw[a:b], len(vocabulary) + 1) for a, b in zip(starts.tolist(), ends.tolist())]
            for k in range(max(1, len(own) - width + 1) if own else 0):
                windows.setdefault(tuple(own[k : k + width]), set()).update([] if item is None else [item])
        hashes = hash_words(list(vocabulary))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.phrases = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.phrases[k, : len(w)] = w
        self.items = [sorted(s) for s in windows.values()]

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 0 for words that no item has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.numbers[spot], 0)


def search_shard(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Word counts of a shard's texts, and per text with hits its byte spans and items."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    n_words = np.diff(first)
    if not len(starts) or not len(windows.lengths):
        return n_words, {}
    numbers = windows.numbered(span_hashes(data, starts, ends))
    # Runs of known words inside a text, as long as the shortest window at least.
    new = np.zeros(len(numbers) + 1, bool)
    new[first] = True
    known = numbers > 0
    opens = np.flatnonzero(known & (new[:-1] | np.r_[True, ~known[:-1]]))
    closes = np.flatnonzero(known & (new[1:] | np.r_[~known[1:], True])) + 1
    long = closes - opens >= windows.lengths.min()
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return n_words, {}
    sizes = closes - opens + 1  # each run and a separator
    to = np.cumsum(sizes) - sizes
    where = np.repeat(opens - to, sizes) + np.arange(int(sizes.sum()))
    seq = numbers[np.minimum(where, len(numbers) - 1)]
    seq[to + sizes - 1] = 0
    index = FMIndex(seq, len(windows.hashes))
    lo, hi = index.search(windows.phrases, windows.lengths)
    window = np.repeat(np.arange(len(lo)), hi - lo)
    if not len(window):
        return n_words, {}
    rows = np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    at = where[index.locate(rows)]  # word numbers within the shard
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    text_of = np.searchsorted(first, at, "right") - 1
    found: dict[int, tuple[list, set]] = {}
    for t, w in set(zip(text_of.tolist(), window.tolist())):
        found.setdefault(t, ([], set()))[1].update(windows.items[w])
    for t, (spans, _) in found.items():
        own = hit[first[t] : first[t + 1]].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.r_[0, own, 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            spans.append((a, b, int(starts[first[t] + a] - offsets[t]), int(ends[first[t] + b - 1] - offsets[t])))
    return n_words, found


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            p = out[-1]
            out[-1] = (p[0], max(b, p[1]), p[2], max(d, p[3]))
        else:
            out.append((a, b, c, d))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_words, items, spans): one row per document row.

    ``items``: ids as strings, sorted; ``spans``: merged hits as structs of
    word positions (first, past) and byte offsets of the text (start, stop).
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    schema = keyed_schema(docs, doc_id, "text string, n_words long, items array<string>, spans array<struct<first:long,past:long,start:long,stop:long>>")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:long,past:long,start:long,stop:long>>").alias("spans"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Windows([(r.i, r.t) for r in part], width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for b in batches:
                data, offsets = column_bytes(b.column(1))
                for i, j in slices(offsets, SHARD_BYTES):
                    n_words, found = search_shard(windows, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    part = b.slice(i, j - i)
                    items, spans = part.column(3), part.column(4)
                    if found:
                        items, spans = items.to_pylist(), [[tuple(s.values()) for s in row] for row in spans.to_pylist()]
                        for t, (more, own) in found.items():
                            spans[t], items[t] = _merged(spans[t] + more), sorted({*items[t], *own})
                        names = [f.name for f in part.schema.field(4).type.value_type]
                        spans = pa.array([[dict(zip(names, s)) for s in row] for row in spans], part.schema.field(4).type)
                        items = pa.array(items, part.schema.field(3).type)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), items, spans], schema=part.schema)

        out = out.mapInArrow(returning(run), schema)
    return out


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least a twentieth of the words hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.past - x.first)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
