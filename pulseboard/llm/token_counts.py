"""Operator 6: token counts with the whole-token shortcut.

Offline, every vocabulary string that can end a word is merged alone: those
that come out as one token are proven whole tokens, and a pre-token equal to
one counts 1 without merging. Only the rest is merged, each distinct word once
per worker. Counts equal those of the library that reads the same file.

Null and empty texts have no tokens. Texts are never cut; memory follows the
longest one. Repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

import gc
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.bpe import BytePairs
from pulseboard.llm.shared import keyed_schema

#: Fixed value: the published splitting pattern of this kind of vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A worker forgets the merged words it keeps beyond so many.
KEPT_WORDS = 500_000


def normal(text: str) -> str:
    """Composed and lower-cased character by character (capital sigma has one lower case)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Counter:
    """Token counts of texts; ``whole`` holds the pre-tokens proven to be one token."""

    def __init__(self, tokenizer: str):
        self.pairs = BytePairs(tokenizer)
        self.find = regex.compile(PRE_TOKEN).findall
        specials = self.pairs.specials
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.whole = self.proven()
        self.merged: dict[str, int] = {}

    def proven(self) -> dict[str, int]:
        """The vocabulary strings that, encoded alone, give their own id and nothing else."""
        end = self.pairs.end
        own = [(i, self.pairs.token_bytes[i]) for s, i in self.pairs.vocab.items() if s.endswith(end) and s not in self.pairs.specials]
        ids, starts = self.pairs.encode([w for _, w in own])
        out = {}
        for k, (i, w) in enumerate(own):
            if starts[k + 1] - starts[k] == 1 and ids[starts[k]] == i:
                try:
                    out[w.decode()] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        split, specials = [], []
        for t in texts:
            found, t = 0, t or ""
            if self.special is not None and "<|" in t:
                parts = self.special.split(t)
                found, words = len(parts) - 1, [w for p in parts for w in self.find(normal(p))]
            else:
                words = self.find(normal(t))
            split.append(words)
            specials.append(found)
        if len(self.merged) > KEPT_WORDS or not self.merged:
            self.merged = dict(self.whole)
        known = self.merged
        new = list({w for words in split for w in words if w not in known})
        if new:
            _, ends = self.pairs.encode([w.encode() for w in new])
            known.update(zip(new, (ends[1:] - ends[:-1]).tolist()))
        get = known.__getitem__
        return [sum(map(get, words)) + n for words, n in zip(split, specials)]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``tokenizer`` is a path that exists on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer)
        counter = _COUNTERS[tokenizer]
        gc.disable()  # nothing here makes cycles, and scans of the kept words are slow
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n = counter.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return own.mapInArrow(run, keyed_schema(docs, doc_id, "n_bytes long, n_tokens long"))
