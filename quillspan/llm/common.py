"""Shared pieces: scratch tables, Arrow text access, vectorised word hashing.

Everything here works on whole Arrow buffers with NumPy, so that per-row Python
code is only left where an algorithm is inherently sequential.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
ARROW_BYTES = 4 << 20


# ---- scratch tables
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is set, a folder of our own, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspan-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation.
    ``discard`` removes the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._scratch_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished stages, which it does once the driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


# ---- memory of Python workers
@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside send at most ``ARROW_BYTES`` to a Python worker at once, a longer row alone.

    Spark's 64 MB are held several times over, outside the heap of the executor
    and in the worker. What a function returns must not depend on where batches end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= ARROW_BYTES:
        yield
        return
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Return what was freed to the system: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of one argument that works in Python workers, with ``give_back`` at its end."""

    @functools.wraps(run)
    def each(data):
        yield from run(data)
        give_back()

    @functools.wraps(run)
    def whole(data):
        out = run(data)
        give_back()
        return out

    return each if inspect.isgeneratorfunction(run) else whole


def named(name: str):
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_clashes(df: DataFrame, *new: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add (case-insensitive)."""
    taken = {n.lower() for n in new}
    return df.select(*[named(c) for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, have = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# ---- Arrow text
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone and whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ---- hashing
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), applied in place to a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of codes[j] * B**j over j < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the sequence below ``prefix``; the same content gives the same hash anywhere."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_CODES = BYTE_CODES[LOWER]


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a run of ASCII letters, digits, ``_`` and non-ASCII bytes inside one text."""
    is_word = WORD[flat]
    cut = np.zeros(len(flat) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(flat) + 1, bool)
    before[1:] = is_word
    here = np.zeros(len(flat) + 1, bool)
    here[:-1] = is_word
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in order, ASCII case folded. Lower-case other letters first (``lower_texts``)."""
    start, end, row = word_spans(flat, offsets)
    prefix = prefix_hash(_LOWER_CODES[flat])
    return mix(range_hash(prefix, start, end) + (end - start).astype(np.uint64)), row


def lower_texts(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to one word (lower case)."""
    flat = np.frombuffer(word.encode(), np.uint8)
    return int(words(flat, np.array([0, len(flat)]))[0][0])


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's run in a sorted row-number array."""
    return np.searchsorted(row, np.arange(n + 1))


def ragged(offsets: np.ndarray, blob: np.ndarray) -> pa.Array:
    """A binary column with the bytes between each two of ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(blob))])


# ---- membership filter of a fixed size
BLOOM_BITS = 26


def bloom(ids: DataFrame, column: str, bits: int = BLOOM_BITS):
    """A predicate on a long column that holds for all ``ids[column]`` and few others.

    The filter has 2**bits bits whatever the table's size, so what is sent to the
    executors is at most 8 MB; a full one only lets more rows through.
    """
    at = F.pmod(named(column), F.lit(1 << bits))
    words_ = ids.select((at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words_["w"].to_numpy(np.int64)] = words_["b"].to_numpy(np.int64)
    flags = np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little") if len(words_) else np.zeros(1 << bits, np.uint8)
    packed = np.packbits(flags)

    @F.arrow_udf("boolean")
    def inside(x: pa.Array) -> pa.Array:
        k = x.to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
        return pa.array((packed[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1)

    return inside
