"""Operator 8: exact byte-level BPE encoding and decoding with a transducer lexicon.

1. Pre-tokens are counted over all texts. Those that occur at least once in
   every ``bytes / lexicon_size`` bytes (there can be no more than
   ``lexicon_size``) are merged once, on the driver, and compiled into a
   shared-suffix transducer.
2. Workers map the transducer's file. A pre-token found there takes its ids
   from it; every other one is merged exactly. Both give the same ids.
3. Decoding concatenates the bytes of the ids.

Null text counts as empty: no ids, empty decoded text. Ill-formed UTF-8 cannot
reach it, as Spark strings are decoded first. Very long texts pass through in
the same way; memory follows the longest text. Repeated rows give repeated
rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.llm.bpe import BytePairs
from pulseboard.llm.lexicon import Transducer
from pulseboard.llm.shared import column_bytes, hand_back, keyed_schema, returning, scratch_path, slices, write_bytes

#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that the transducer holds at most.
LEXICON_SIZE = 1 << 19
#: A worker forgets the words it keeps, and their ids, beyond so many.
KEPT_WORDS, KEPT_IDS = 300_000, 1 << 21
#: Bytes of text encoded at once.
RUN_BYTES = 1 << 20


def count_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): all pre-tokens of all texts; counted in the tasks before the shuffle.

    A space between two other characters than white space always begins a pre-token, so texts in which
    none follows white space are counted by what stands between their spaces, and each such piece is
    split once a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, pieces = regex.compile(PRE_TOKEN).findall, collections.Counter(), collections.Counter()
        spaces = regex.compile(r"\s ").search

        def rows() -> pa.RecordBatch:
            for piece, n in pieces.items():
                for word in find(piece[1:] if piece[:1] == " " else " " + piece):
                    seen[word] += n
            pieces.clear()
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    body = t.as_py()
                    if spaces(body):
                        seen.update(find(body))
                    else:
                        parts = body.split(" ")
                        parts[0] = " " + parts[0]  # the one piece without a space before it
                        pieces.update(parts)
                    if len(seen) + len(pieces) > KEPT_WORDS:
                        yield rows()
        if seen or pieces:
            yield rows()

    return docs.select(text).mapInArrow(returning(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, pairs: BytePairs, size: int, text: str = "text") -> Transducer:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    frequent = count_pre_tokens(docs, text).where(F.col("n") * size >= F.lit(total)).select("word")
    words = sorted(r.word.encode() for r in frequent.collect())
    return Transducer.compile(words, *pairs.encode(words))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[k] .. starts[k] + lengths[k] - 1`` of all k, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """A worker's state: the mapped transducer, the merges, and the words met lately.

    Those are numbers into one flat array of ids, so a word takes its key, a
    number and four bytes an id.
    """

    def __init__(self, tokenizer: str, lexicon: str):
        self.pairs = BytePairs(tokenizer)
        self.lexicon = Transducer.mapped(lexicon)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.pairs.specials)) + ")") if self.pairs.specials else None
        table = self.pairs.token_bytes
        self.token_sizes = np.array([len(t) for t in table], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_text = np.frombuffer(b"".join(table), np.uint8)
        # A row a token id: its decimal digits and a comma, the last ``digit_sizes`` cells of the row.
        decimals = [b"%d," % i for i in range(len(table))]
        self.digit_sizes = np.array([len(x) for x in decimals], np.int64)
        self.width = int(self.digit_sizes.max())
        self.digits = np.frombuffer(b"".join(x.rjust(self.width) for x in decimals), np.uint8).reshape(-1, self.width)
        self.forget()

    def forget(self) -> None:
        specials = self.pairs.specials
        self.known: dict[str, int] = {s: k for k, s in enumerate(specials)}
        self.ids = np.array(list(specials.values()), np.int32)
        self.starts = np.arange(len(specials) + 1, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Ids of these pre-tokens: from the transducer, or by merging."""
        raw = [w.encode() for w in words]
        place = self.lexicon.find(raw)
        rest = np.flatnonzero(place < 0)
        merged, ends = self.pairs.encode([raw[k] for k in rest])
        sizes = np.zeros(len(words), np.int64)
        sizes[rest] = np.diff(ends)
        held = np.flatnonzero(place >= 0)
        begin = np.asarray(self.lexicon.starts)[place[held]]
        sizes[held] = np.asarray(self.lexicon.starts)[place[held] + 1] - begin
        at = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[_spread(at[rest], sizes[rest])] = merged
        ids[_spread(at[held], sizes[held])] = self.lexicon.ids[_spread(begin, sizes[held])]
        self.known.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.find(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.find(part))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n+1 offsets of the texts."""
        if len(self.known) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self.forget()
        words: list[str] = []
        counts = [0]
        for t in texts:
            words += self.split(t)
            counts.append(len(words))
        number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [words[k] for k in new]
            self.learn(list(dict.fromkeys(fresh)))
            number[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(new))
        sizes = self.starts[number + 1] - self.starts[number]
        ends = np.append(0, np.cumsum(sizes))[counts]
        return self.ids[_spread(self.starts[number], sizes)], ends

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Per text the text that its ids stand for."""
        sizes = self.token_sizes[ids]
        raw = self.token_text[_spread(self.token_starts[ids], sizes)].tobytes()
        at = np.append(0, np.cumsum(sizes))[ends].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]

    def listed(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Per text its ids in decimal, joined by commas."""
        sizes = self.digit_sizes[ids]
        cells = np.arange(self.width)[None, :] >= (self.width - sizes)[:, None]
        raw = self.digits[ids][cells].tobytes()
        at = np.append(0, np.cumsum(sizes))[ends].tolist()
        return [raw[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", lexicon_size: int = LEXICON_SIZE, outputs: str = "n_tokens ids decoded") -> DataFrame:
    """(doc_id, ...) with the named outputs of every row.

    ``outputs`` names some of n_tokens, ids (array of int), decoded (string),
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    ``tokenizer`` is a path that exists on every machine.
    """
    spark = docs.sparkSession
    lexicon = compile_lexicon(docs, BytePairs(tokenizer), lexicon_size, text)
    path = scratch_path(spark, "lexicon")
    write_bytes(spark, path, lexicon.dump())
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    wanted = outputs.split()
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def columns(encoder: Encoder, texts: pa.Array) -> Iterator[pa.Array]:
        ids, ends = encoder.encode(texts.to_pylist())
        decoded = encoder.decoded(ids, ends) if {"decoded", "decoded_sha256"} & set(wanted) else []
        for column in wanted:
            if column == "n_tokens":
                yield pa.array(np.diff(ends), pa.int64())
            elif column == "ids":
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            elif column == "decoded":
                yield pa.array(decoded, pa.string())
            elif column == "decoded_sha256":
                yield pa.array([digest(x.encode()) for x in decoded], pa.string())
            else:
                yield pa.array([digest(x) for x in encoder.listed(ids, ends)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, name) not in _ENCODERS:
            _ENCODERS.clear()
            hand_back()  # what other operators of this worker held
            _ENCODERS[tokenizer, name] = Encoder(tokenizer, SparkFiles.get(name))
        encoder = _ENCODERS[tokenizer, name]
        for b in batches:
            _, offsets = column_bytes(b.column(1))
            for i, j in slices(offsets, RUN_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(encoder, part.column(1))], names=["doc_id", *wanted])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(returning(run), keyed_schema(docs, doc_id, ", ".join(f"{c} {kinds[c]}" for c in wanted)))
