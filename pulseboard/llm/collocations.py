"""Operator 12: collocations from suffix subtrees of vertically partitioned prefixes.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
into words ``[^\\x20\\x09]+``; everything is counted per language. Every word
starts a suffix, cut off after ``longest`` words or at the end of its piece.

1. Vertical partitioning: one scan counts the suffixes below one-word and
   two-word prefixes, in hashed cells of a bounded array. Prefixes are packed
   into groups of at most ``budget`` suffixes; a one-word prefix above half of
   that is cut into its two-word prefixes, and one of those, if it is still too
   frequent, into whole suffixes. So a word, or a pair, that begins a third of
   all suffixes is spread over many groups.
2. Subtrees: a second scan deals the suffixes (equal ones of a few megabytes of
   text merged before) to their groups. Each group sorts its suffixes, which
   lays out its depth-truncated suffix tree from left to right: a node is a run
   of suffixes with equal first words, and its count is the total of its leaves.
   Nodes above the group's prefixes are sums over groups.
3. Spark joins parts and longer phrases to the counts of the nodes and ranks
   them. Only then are words needed as strings; a third scan reads them off
   the texts for the phrases up to the last place (with ties).

No subtree, cell array or broadcast grows with the input; the groups grow in
number. Words are told apart by 64-bit hashes.

A null text is empty; a null language is ``und``. Repeated rows count again.
A table without words gives no rows. Ids are not read, and extra columns are
left out. Ties are broken by the phrase, in the order of its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseboard.llm.shared import LOWER, byte_class, column_bytes, dropped, mixed, slices, span_hashes, stored, summed_array, word_bounds

UND = "und"
#: Words of a phrase at most; occurrences at least; phrases of a language; per cent of a phrase inside a longer one.
LONGEST, LEAST, KEEP, COVERED = 3, 10, 2000, 50
#: Suffixes of a group; least and most cells of the array of prefix counts; bytes of text merged at once.
BUDGET, FEW_CELLS, MANY_CELLS, RUN_BYTES = 1 << 19, 1 << 12, 1 << 21, 1 << 22
#: Suffixes handled at once.
RUN_WORDS = 1 << 20
#: Bits of the filter of words whose strings are read.
FILTER_BITS = 1 << 20

_BREAK = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
_WORD = ~(_BREAK | byte_class((0x20, 0x20), (0x09, 0x09)))
#: Stands for no word at the end of a shorter suffix; no word is hashed to it (``_words``).
_END = np.uint64(0)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: byte starts and ends, hashes, whether a piece begins there; and the word offsets of the texts."""
    low = LOWER[data]
    starts, ends, of_text = word_bounds(low, offsets, _WORD)
    hashes = np.empty(len(starts), np.uint64)
    for i, j in slices(np.append(starts, len(data))):  # a long text is hashed piece by piece
        hashes[i:j] = span_hashes(low[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
    hashes = np.maximum(hashes, np.uint64(1))
    breaks = np.flatnonzero(_BREAK[low])
    first = np.ones(len(starts), bool)
    first[1:] = np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
    first[of_text[:-1][np.diff(of_text) > 0]] = True
    return starts, ends, hashes, first, of_text


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes, offsets) of the texts of each language, a few megabytes at a time."""
    lang = batch.column(0).fill_null(UND)
    for name in lang.unique().to_pylist():
        texts = batch.column(1).filter(pa.compute.equal(lang, name))
        data, offsets = column_bytes(texts)
        for i, j in slices(offsets, RUN_BYTES):
            yield name, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _suffixes(hashes: np.ndarray, first: np.ndarray, longest: int) -> list[np.ndarray]:
    """Per depth, the word at that depth of the suffix that begins at each word."""
    columns, open_ = [hashes], np.ones(len(hashes), bool)
    for depth in range(1, longest):
        after = np.full(len(hashes), _END)
        after[:-depth] = np.where(first[depth:], _END, hashes[depth:])
        open_[-depth:] = False
        open_[:-depth] &= ~first[depth:]
        columns.append(np.where(open_, after, _END))
    return columns


def _blocks(n: int, longest: int) -> Iterator[tuple[slice, int]]:
    """Slices of ``n`` words that hold whole suffixes, and how many of a slice's words begin one."""
    for i in range(0, n, RUN_WORDS):
        yield slice(i, min(n, i + RUN_WORDS + longest - 1)), min(RUN_WORDS, n - i)


def _prefix_hashes(lang: str, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Per depth, the hash of a suffix's first words in its language."""
    key = np.frombuffer(lang.encode(), np.uint8)
    h = np.full(len(columns[0]), span_hashes(key, np.array([0]), np.array([len(key)]))[0])
    out = []
    for c in columns:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + c)
        out.append(h)
    return out


def _merged(columns: list[np.ndarray], counts: np.ndarray | None, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of word numbers below ``words``, and how often each stands there."""
    bits = max(1, int(words).bit_length())
    if bits * len(columns) <= 63:
        packed = reduce(lambda a, c: a << np.int64(bits) | c, [c.astype(np.int64) for c in columns])
        if counts is None:
            packed = np.sort(packed)
        else:
            order = np.argsort(packed, kind="stable")
            packed, counts = packed[order], counts[order]
        new = np.ones(len(packed), bool)
        new[1:] = packed[1:] != packed[:-1]
        rest, mask, out = packed[new], np.int64((1 << bits) - 1), []
        for _ in columns:
            out.append(rest & mask)
            rest = rest >> np.int64(bits)
        out.reverse()
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        counts = None if counts is None else counts[order]
        new = np.ones(len(order), bool)
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
        out = [c[new] for c in columns]
    at = np.flatnonzero(new)
    if counts is None:
        return out, np.diff(np.append(at, len(new)))
    return out, np.add.reduceat(counts, at) if len(at) else counts[:0]


class Partition:
    """The group of every suffix: by one-word, two-word or whole prefixes, as frequent as they are.

    ``bounds`` are the first group of two-word prefixes and the first of whole suffixes.
    """

    def __init__(self, ones: np.ndarray, twos: np.ndarray, budget: int):
        self.cells = len(ones)
        self.groups = 0
        self.one_at, self.one_ways = self._packed(ones, budget, split=False)
        two_from = self.groups
        self.two_at, self.two_ways = self._packed(twos, budget, split=True)
        self.bounds = two_from, self.groups - int(self.two_ways.sum())

    def _packed(self, totals: np.ndarray, budget: int, split: bool) -> tuple[np.ndarray, np.ndarray]:
        """First group of each cell and, of those above half the budget, the number of its groups."""
        heavy = totals > budget // 2
        running = np.cumsum(np.where(heavy, 0, totals))
        at = self.groups + running // max(1, budget // 2)
        self.groups = int(at[-1]) + 1
        ways = np.where(heavy, -(-totals // max(1, budget // 2)), 0)
        if split:
            at = np.where(heavy, self.groups + np.cumsum(ways) - ways, at)
            self.groups += int(ways.sum())
        return at.astype(np.int32), ways.astype(np.int32)

    def of(self, prefixes: list[np.ndarray]) -> np.ndarray:
        cell = lambda h: (h % np.uint64(self.cells)).astype(np.int64)
        one, two = cell(prefixes[0]), cell(prefixes[min(1, len(prefixes) - 1)])
        ways = self.two_ways[two]
        spread = ((prefixes[-1] >> np.uint64(24)) % np.maximum(ways, 1).astype(np.uint64)).astype(np.int64)
        return np.where(self.one_ways[one] == 0, self.one_at[one], self.two_at[two] + spread)


def partition(texts: DataFrame, longest: int, budget: int) -> Partition:
    """``texts`` holds (lang, text)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = FEW_CELLS
    while cells < min(MANY_CELLS, 4 * size // budget):
        cells *= 2

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for lang, data, offsets in _runs(batch):
            _, _, hashes, first, _ = _words(data, offsets)
            for block, n in _blocks(len(hashes), 2):
                columns = [c[:n] for c in _suffixes(hashes[block], first[block], 2)]
                for k, h in enumerate(_prefix_hashes(lang, columns)):
                    total[k * cells : (k + 1) * cells] += np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells)

    totals = summed_array(texts, 2 * cells, add)
    return Partition(totals[:cells], totals[cells:], budget)


def _payloads(plan: Partition, lang: str, hashes: np.ndarray, first: np.ndarray, n: int, longest: int) -> pa.RecordBatch:
    """The suffixes of the first ``n`` words, one row a group."""
    words, number = np.unique(hashes, return_inverse=True)
    words, number = np.append(_END, words), number + 1
    suffixes = [c[:n] for c in _suffixes(number.astype(np.uint64), first, longest)]
    numbers, counts = _merged(suffixes, None, len(words))
    group = plan.of(_prefix_hashes(lang, [words[c] for c in numbers]))
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group))
    out: dict[str, list] = {"group": [], "words": [], "numbers": [], "counts": []}
    for i, j in zip(cuts[:-1], cuts[1:]):
        part = order[i:j]
        used, again = np.unique(np.concatenate([c[part] for c in numbers]), return_inverse=True)
        kind = np.uint8 if len(used) <= 1 << 8 else np.uint16 if len(used) <= 1 << 16 else np.uint32
        out["group"].append(int(group[i]))
        out["words"].append(words[used].tobytes())
        out["numbers"].append(again.astype(kind).tobytes())
        out["counts"].append(counts[part].astype(np.int32).tobytes())
    arrays = [pa.array(out["group"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("words", "numbers", "counts")]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([lang] * len(out["group"]), pa.string())], names=["group", "words", "numbers", "counts", "lang"])


def _dealt(texts: DataFrame, plan: Partition, longest: int) -> DataFrame:
    """Suffixes by group: a run's words, the distinct suffixes as numbers of them, and their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for lang, data, offsets in _runs(b):
                _, _, hashes, first, _ = _words(data, offsets)
                for block, n in _blocks(len(hashes), longest):
                    yield _payloads(own, lang, hashes[block], first[block], n, longest)

    return texts.mapInArrow(run, "group long, words binary, numbers binary, counts binary, lang string")


def _subtrees(bounds: tuple[int, int], longest: int, least: int):
    names = [f"w{k + 1}" for k in range(longest)]

    def build(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        whole = 1 if group < bounds[0] else 2 if group < bounds[1] else longest  # nodes from this depth on are whole here
        langs = table.column("lang")
        out: dict[str, list] = {c: [] for c in ["lang", "depth", "n", *names]}
        for lang in langs.unique().to_pylist():
            rows = table.filter(pa.compute.equal(langs, lang))
            lists, columns, totals, base = [], [], [], 0
            for w, x, c in zip(*[rows.column(k).to_pylist() for k in ("words", "numbers", "counts")]):
                counts = np.frombuffer(c, np.int32)
                kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // (longest * len(counts))]
                columns.append(np.frombuffer(x, kind).reshape(longest, -1).astype(np.int64) + base)
                lists.append(np.frombuffer(w, np.uint64))
                totals.append(counts.astype(np.int64))
                base += len(lists[-1])
            words, number = np.unique(np.concatenate(lists), return_inverse=True)
            every = number[np.concatenate(columns, axis=1)]
            # Sorted suffixes are the leaves of the group's suffix tree from left to right.
            leaves, n = _merged(list(every), np.concatenate(totals), len(words))
            spelt = [words[c] for c in leaves]
            new = np.zeros(len(n), bool)
            for depth in range(1, longest + 1):
                new[0] = True
                new[1:] |= spelt[depth - 1][1:] != spelt[depth - 1][:-1]
                at = np.flatnonzero(new)
                count = np.add.reduceat(n, at)
                node = (spelt[depth - 1][at] != _END) & ((count >= least) | (depth < whole))
                out["n"].append(count[node])
                out["depth"].append(np.full(int(node.sum()), depth))
                for k, c in enumerate(names):
                    out[c].append(spelt[k][at][node] if k < depth else np.zeros(int(node.sum()), np.uint64))
                out["lang"].extend([lang] * int(node.sum()))
        flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items() if k != "lang"}
        arrays = {"lang": pa.array(out["lang"], pa.string()), "depth": pa.array(flat["depth"].astype(np.int32))}
        arrays |= {c: pa.array(flat[c].astype(np.uint64).view(np.int64)) for c in names}
        return pa.table(arrays | {"n": pa.array(flat["n"].astype(np.int64))})

    return build


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, depth, w1 .. w`longest`, n): every phrase of up to ``longest`` words with at least ``least`` occurrences.

    Words are hashes; those beyond ``depth`` are 0.
    """
    texts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    plan = partition(texts, longest, budget)
    names = [f"w{k + 1}" for k in range(longest)]
    schema = "lang string, depth int, " + ", ".join(f"{c} long" for c in names) + ", n long"
    nodes = _dealt(texts, plan, longest).groupBy("group").applyInArrow(_subtrees(plan.bounds, longest, least), schema)
    # Nodes above the prefixes of their groups come in parts.
    return nodes.groupBy("lang", "depth", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut_score(a: Column, first: Column, rest: Column) -> Column:
    exact = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a)).cast("decimal(31,0)"), exact(first) * exact(rest))


def scored_phrases(counts: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """(lang, depth, words, a, l, r, score) of the phrases of two and more words that no longer phrase covers."""
    names = [f"w{k + 1}" for k in range(longest)]

    def of_depth(depth: int) -> DataFrame:
        return counts.where(F.col("depth") == depth).select("lang", *names[:depth], F.col("n").alias("a"))

    def parts(start: int, end: int, alias: str) -> DataFrame:
        """The counts of phrases as words ``start`` to ``end`` of a longer one."""
        own = of_depth(end - start)
        return own.select("lang", *[F.col(names[k]).alias(names[start + k]) for k in range(end - start)], F.col("a").alias(alias))

    out = []
    for depth in range(2, longest + 1):
        rows = of_depth(depth)
        for k in range(1, depth):
            rows = rows.join(parts(0, k, f"l{k}"), ["lang", *names[:k]]).join(parts(k, depth, f"r{k}"), ["lang", *names[k:depth]])
        cuts = [F.struct(_cut_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, depth)]
        rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        inside = []
        for longer in range(depth + 1, longest + 1):
            own = of_depth(longer)
            for start in range(longer - depth + 1):
                inside.append(own.select("lang", *[F.col(names[start + k]).alias(names[k]) for k in range(depth)], F.col("a").alias("above")))
        if inside:
            most = reduce(DataFrame.unionByName, inside).groupBy("lang", *names[:depth]).agg(F.max("above").alias("above"))
            rows = rows.join(most, ["lang", *names[:depth]], "left").where(F.coalesce(100 * F.col("above") < covered * F.col("a"), F.lit(True)))
        out.append(rows.select("lang", F.array(*names[:depth]).alias("words"), "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, out)


def _first_places(scored: DataFrame, keep: int) -> DataFrame:
    """All phrases with the scores of the first ``keep`` places of a language, ties of the last place included."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    steps = scored.groupBy("lang", "score", "a").agg(F.count("*").alias("n"))
    # Every step holds a phrase, so the first `keep` steps of a language suffice.
    steps = steps.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < keep)
    return scored.join(steps.select("lang", "score", "a"), ["lang", "score", "a"])


def _filter_bits(words: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds the hashes of column ``w``."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER_BITS)
        total[h.astype(np.int64)] = 1

    return summed_array(words.select("w"), FILTER_BITS, add) > 0


def _spelt(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(lang, w, word, n): the words that may be wanted, each once a task or more; and with a null word,
    the word occurrences of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total, said = shared.value, {}, {}
        for b in batches:
            for lang, data, offsets in _runs(b):
                starts, ends, hashes, _, _ = _words(data, offsets)
                total[lang] = total.get(lang, 0) + len(hashes)
                cell = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
                some = np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                once, at = np.unique(hashes[some], return_index=True)
                known = said.setdefault(lang, np.zeros(0, np.uint64))
                fresh = ~np.isin(once, known)
                once, at = once[fresh], some[at[fresh]]
                said[lang] = np.append(known, once)[-FILTER_BITS:]
                low = LOWER[data]
                spelt = [low[i:j].tobytes() for i, j in zip(starts[at], ends[at])]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "w": pa.array(once.view(np.int64)), "word": pa.array(spelt, pa.binary()).cast(pa.string()), "n": pa.array([0] * len(at), pa.int64())})
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "w": pa.array([0] * len(total), pa.int64()), "word": pa.nulls(len(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return texts.mapInArrow(run, "lang string, w long, word string, n long")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, keep: int = KEEP, covered: int = COVERED, budget: int = BUDGET
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``keep`` phrases of every language."""
    texts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = stored(phrase_counts(texts, longest=longest, least=least, budget=budget), "phrases")
    first = stored(_first_places(scored_phrases(counts, longest, covered), keep), "first")
    dropped(counts)
    wanted = first.select("lang", F.explode("words").alias("w")).distinct()
    spelt = stored(_spelt(texts, _filter_bits(wanted)), "words")
    sizes = spelt.where("word is null").groupBy("lang").agg(F.sum("n").alias("n"))
    lexicon = spelt.where("word is not null").select("lang", "w", "word").distinct()
    # A phrase is put together again from its words.
    placed = first.select("lang", "words", F.posexplode("words").alias("at", "w")).join(lexicon, ["lang", "w"])
    phrases = placed.groupBy("lang", "words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = first.join(phrases, ["lang", "words"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return named.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
