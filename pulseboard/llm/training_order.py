"""Operator 2: training-order materialisation of token sequences into binary shards.

Texts become token ids, cut into sequences of at most ``length``. Sequence k of
the document with id d has the grid number ((d - least id) * spread + h) * most
+ k, where ``most`` bounds the sequences of a document (a token has a byte at
least), ``spread`` is the rows of the id that most rows have (1 if ids are
unique; less where the grid would pass 63 bits) and h < ``spread`` a hash of the text.
Ids that are no integers, or so wide apart that the grid would pass 63 bits (as
64-bit hashes are), are replaced by a hash of id and text on a grid of 2^62 numbers. A
keyed Feistel network permutes the grid; cycle-walking (applying it again while
the result lies outside) keeps it on the grid. Ranges of the permuted numbers
are the shards: one task sorts one shard and writes its sequences as records of
a fixed stride, padded with the end mark, under a temporary name that is then
moved into place. Slots count the records of all shards in order, so slot s
lies at a known byte of a known file, and a reader can start anywhere.

A number depends on the key and the row alone, never on partitions, so a task
that runs again writes the same file. A null or empty text has no sequence. Null
integer ids count as the id past the largest; equal numbers (copies of a row, rare
others) are ordered by their ids' bytes, each keeping a slot of its own, and
stay side by side in one shard. Texts are
encoded whole; memory follows the longest one and one shard. An empty table
writes no shard. Extra columns are left out.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseboard.llm.shared import keyed_schema, mixed, stored, write_bytes

#: Tokens of a record; records of a shard aimed at; rounds of the network.
LENGTH, SHARD_RECORDS, ROUNDS = 512, 8192, 6


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of [0, size)."""

    size: int
    key: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        half = np.uint64(max(1, -(-int(self.size - 1).bit_length() // 2)))
        mask = (np.uint64(1) << half) - np.uint64(1)
        keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.key & 0xFFFFFFFFFFFFFFFF))
        out = x.astype(np.uint64)
        walking = np.arange(len(out))
        while len(walking):
            left, right = out[walking] >> half, out[walking] & mask
            for k in keys:
                left, right = right, left ^ (mixed(right + k) & mask)
            out[walking] = left << half | right
            walking = walking[out[walking] >= np.uint64(self.size)]
        return out


@dataclass(frozen=True)
class Layout:
    """Where records lie: ``grid`` numbers in ``shards`` ranges, records of ``length`` ids of ``width`` bytes."""

    grid: int
    shards: int
    length: int
    width: int
    end: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    def shard(self, number: np.ndarray) -> np.ndarray:
        step = -(-self.grid // self.shards)
        return (number // np.uint64(step)).astype(np.int32)

    def file(self, shard: int) -> str:
        return f"shard-{shard:08d}.bin"


class _Ids:
    """A worker's encoder of a public rank file."""

    kept: dict[str, _Ids] = {}

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, ranks: str, pattern: str) -> _Ids:
        if ranks not in cls.kept:
            cls.kept[ranks] = cls(ranks, pattern)
        return cls.kept[ranks]


def _vocabulary_size(ranks: str) -> int:
    with open(ranks, "rb") as f:
        return 1 + max(int(line.split()[1]) for line in f)


def sequences(docs: DataFrame, layout: Layout, base: Column, most: int, ranks: str, pattern: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, seq_no, n_tokens, shard, number, ids): unpadded records with their permuted numbers; ``base``
    numbers the documents."""
    permute = Feistel(layout.grid, layout.key)
    kind = np.uint16 if layout.width == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Ids.of(ranks, pattern).encode
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = part.column(1).to_pylist()
                row, seq, parts = [], [], []
                for r, t in enumerate(texts):
                    ids = np.array(encode(t), kind) if t else ()
                    for s, at in enumerate(range(0, len(ids), layout.length)):
                        row.append(r)
                        seq.append(s)
                        parts.append(ids[at : at + layout.length].tobytes())
                if not row:
                    continue
                first = part.column(2).to_numpy().astype(np.uint64) * np.uint64(most)
                number = permute(first[row] + np.array(seq, np.uint64))
                columns = [part.column(0).take(pa.array(row)), pa.array(seq, pa.int64()), pa.array([len(p) // layout.width for p in parts], pa.int32()), pa.array(layout.shard(number)), pa.array(number.astype(np.int64)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "seq_no", "n_tokens", "shard", "number", "ids"])

    return docs.select(doc_id, text, base).mapInArrow(run, keyed_schema(docs, doc_id, "seq_no long, n_tokens int, shard int, number long, ids binary"))


def _writer(layout: Layout, folder: str):
    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        number, ids = table.column("number").to_pylist(), table.column("ids").to_pylist()
        order = sorted(range(len(number)), key=lambda k: (number[k], ids[k]))
        end = np.array([layout.end], np.uint16 if layout.width == 2 else np.uint32).tobytes()
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        made = f"{path}/.{uuid.uuid4().hex}"
        with files.open_output_stream(made) as out:
            for k in order:
                out.write(ids[k] + end * ((layout.stride - len(ids[k])) // layout.width))
        place = f"{path}/{layout.file(shard)}"
        if files.get_file_info(place).type != pafs.FileType.NotFound:
            files.delete_file(place)  # the same bytes, by a task that ran before: not every store moves onto a file
        files.move(made, place)
        t = table.select(["doc_id", "seq_no", "n_tokens", "shard"]).take(pa.array(order))
        return t.append_column("row", pa.array(range(len(order)), pa.int32()))

    return write


def materialise(docs: DataFrame, folder: str, ranks: str, pattern: str, key: int = 20_240_229, length: int = LENGTH, shard_records: int = SHARD_RECORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards and ``layout.json`` to the URI ``folder``; returns a row per sequence.

    (doc_id, seq_no, n_tokens, slot, shard, position): the record of ``slot``
    begins at byte ``position`` of its shard's file. ``doc_id`` has any type that Spark hashes.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = F.octet_length("text")
    seen = own.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in (("longest", F.max(size)), ("bytes", F.sum(size)), ("texts", F.count_if(size > 0)))]).first()
    most = max(1, -(-seen.longest // length))
    grid = 1 << 63
    if isinstance(own.schema["doc_id"].dataType, T.IntegralType):
        ends = own.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("low"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("high")).first()
        grid = (ends.high - ends.low + 2) * most
    if grid < 1 << 62 and ends.high + 1 < 1 << 63:
        repeats = own.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        spread = min(repeats, ((1 << 63) - 1) // grid)
        grid *= spread
        number = F.coalesce(F.col("doc_id").cast("long"), F.lit(ends.high + 1).cast("long")) - F.lit(ends.low).cast("long")
        base = number * F.lit(spread).cast("long") + F.pmod(F.xxhash64("text"), F.lit(spread).cast("long"))
    else:
        places = (1 << 62) // most
        grid = places * most
        base = F.pmod(F.xxhash64("doc_id", "text"), F.lit(places).cast("long"))
    vocabulary = _vocabulary_size(ranks)
    # About three bytes a token, and a last record half empty, give the number of shards; any number is right.
    expected = seen.bytes / (3 * length) + seen.texts / 2 + 1
    layout = Layout(grid, int(min(grid, max(1, -(-expected // shard_records)))), length, 2 if vocabulary < 1 << 16 else 4, vocabulary, key)
    rows = sequences(own, layout, base, most, ranks, pattern, "doc_id", "text")
    schema = keyed_schema(own, "doc_id", "seq_no long, n_tokens int, shard int, row int")
    index = stored(rows.groupBy("shard").applyInArrow(_writer(layout, folder), schema), "slots")
    sizes = index.groupBy("shard").agg(F.count("*").alias("n"))
    # A row a shard: small enough for one ordered sum.
    bases = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    write_bytes(spark, f"{folder}/layout.json", json.dumps(asdict(layout)).encode())
    return index.join(bases, "shard").select("doc_id", "seq_no", "n_tokens", (F.col("base") + F.col("row")).alias("slot"), "shard", (F.col("row").cast("long") * layout.stride).alias("position"))


def read_records(folder: str, shard: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Consecutive records of a shard from record ``first`` on, as rows of ids: one seek and one read."""
    files, path = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/layout.json") as f:
        layout = Layout(**json.loads(f.read()))
    with files.open_input_file(f"{path}/{layout.file(shard)}") as f:
        f.seek(first * layout.stride)
        data = f.read(None if count is None else count * layout.stride)
    return np.frombuffer(data, np.uint16 if layout.width == 2 else np.uint32).reshape(-1, layout.length)


