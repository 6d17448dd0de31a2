"""Helpers shared by the operators: Spark plumbing and byte-level text arrays.

Texts are handled as the UTF-8 bytes of an Arrow string column, a few megabytes
at a time, so that words, shingles and n-grams come out of numpy operations and
never of per-character Python.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled by one numpy pass; a longer single text is its own pass.
CHUNK_BYTES = 1 << 21
#: Bytes of a batch between Spark and Python; a longer single row is its own batch.
BATCH_BYTES = 1 << 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Only a session on one machine may run without that setting; it gets a
    temporary folder of its own.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulseboard-llm-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """A stored table, to be broadcast if it holds at most ``rows`` rows of a few numbers; else joined as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/llm-" not in folder:
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file of the driver's at any URI that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    for at in range(0, len(data), 1 << 20):
        out.write(data[at : at + (1 << 20)])
    out.close()


def keyed_schema(df: DataFrame, key: str, rest: str) -> T.StructType:
    """``doc_id`` with the type of ``df``'s key, which may be a struct of a whole row, and more columns."""
    return T.StructType([T.StructField("doc_id", df.select(key).schema[0].dataType), *T.StructType.fromDDL(rest).fields])


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where doc_id is a struct of the whole row: operators hand it through."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")


def hand_back() -> None:
    """Free what a reused Python worker still holds for operators that ran in it before."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU systems only
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what the worker holds besides its models is freed when the task ends."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return task


def bounded_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of at most ``BATCH_BYTES`` from now on in this session.

    Texts of a few kilobytes make Spark's default of 64 MB a batch several hundred megabytes an executor:
    the rows stand there as Arrow vectors that grow by doubling, on both sides, in and out, for every core.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


# --- byte arrays of a string column -------------------------------------------------


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of together at most ``most`` bytes (or one longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Lower-cases A-Z and keeps every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the texts."""
    inside = kind[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, as many as needed so far."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit sums over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial sums taken from one running sum."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``span_hashes`` gives to these words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64) if words else ends
    return span_hashes(data, starts, ends)


# --- sums of fixed-size arrays over all tasks ---------------------------------------


def summed_array(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None], chunk: int = 1 << 16) -> np.ndarray:
    """A counter array of fixed size, filled by ``add`` in every task and summed by Spark.

    Each task sends its counters as compressed chunks; one task sums the
    copies of one chunk, two at a time. The driver receives ``size`` numbers,
    whatever the input holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            add(b, total)
        keys = [k for k in range(0, size, chunk) if total[k : k + chunk].any()]
        for k in keys:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // chunk], pa.int32()), "payload": pa.array([zlib.compress(total[k : k + chunk].tobytes(), 1)], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "payload": pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())})

    schema = "chunk int, payload binary"
    parts = df.mapInArrow(count, schema)
    n_chunks = max(1, -(-size // chunk))
    whole = parts.repartition(min(n_chunks, 64), "chunk").mapInArrow(fold, schema)
    out = np.zeros(size, np.int64)
    for row in whole.collect():
        part = np.frombuffer(zlib.decompress(bytes(row.payload)), np.int64)
        out[row.chunk * chunk : row.chunk * chunk + len(part)] = part
    return out
