"""Shared helpers: the cluster's shared folder, scratch tables, text scanning."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, an own folder is made and set, on one machine alone (as
    in tests): on a cluster that is an error, as no machine would see another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_made: list[str] = []


def output_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the scratch tables, for files that are to stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = output_path(spark, name)
    _made.append(path)
    return path


def scratch_made(since: int = 0) -> list[str]:
    """This process's scratch tables in the order they were made."""
    return _made[since:]


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes scratch tables (all of this process without ``paths``), for when all results
    that read them have been written; returns how many there were."""
    configuration, count = spark._jsc.hadoopConfiguration(), 0
    for name in list(_made) if paths is None else paths:
        if name in _made:
            _made.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            count += path.getFileSystem(configuration).delete(path, True)
    return count


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Inside, plans that start hand ``rows`` rows at a time to Python: workers that hold
    much of their own need small buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stored(df: DataFrame, name: str, batch_rows: int = 2000, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage so
    that a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _libc():
    """The C library, told to give large blocks back as soon as they are free; Arrow takes
    its memory from there too, as its own pool keeps what it has had."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def trim() -> None:
    """Gives free memory of this worker back to the machine."""
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A mapper of batches that gives its freed memory back at the end: a worker process
    serves many tasks, and what one leaves in its heap counts against the next."""

    @functools.wraps(run)
    def wrapped(batches):
        _libc()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim()

    return wrapped


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


# --- text scanning ---------------------------------------------------------------

#: Word bytes of the near-duplicate contract: everything but space and \t..\r.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes of the contamination contract: letters, digits and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _lowered(word_bytes: np.ndarray) -> np.ndarray:
    """Byte -> 1 + its lower-cased value, 0 outside words."""
    out = np.arange(256) + 1
    out[65:91] += 32
    return np.where(word_bytes, out, 0).astype(U64)


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xCA5A826395121157)
    return x ^ (x >> U64(29))


def text_chunks(column, limit: int = 1 << 20):
    """Yields (first row, bytes, offsets) for runs of whole texts of about ``limit``
    bytes (one text at least). Null counts as empty; nothing is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_places(inside: np.ndarray, offsets: np.ndarray):
    """(row, start, end) of every word of a run of texts, from the flags of its bytes."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


class WordScanner:
    """Finds the words of a run of texts and a 64-bit hash of each."""

    def __init__(self, word_bytes: np.ndarray):
        self.value = _lowered(word_bytes)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(row, start, end, hash) of every word, in order."""
        return self.with_beginnings(data, offsets, ())[:4]

    def with_beginnings(self, data: np.ndarray, offsets: np.ndarray, sizes):
        """As above, and for each of ``sizes`` the hashes of the words' first so many
        bytes (0 for words that are no longer than that)."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, U64), [np.zeros(0, U64) for _ in sizes]
        value = self.value[data]
        row, start, end = word_places(value != 0, offsets)
        power, inverse = _power_tables(n)
        value *= power
        total = np.cumsum(value, dtype=U64)
        before, back = total[start] - value[start], inverse[start]
        beginnings = []
        for k in sizes:
            at = np.minimum(start + k, end) - 1
            beginnings.append(np.where(end - start > k, mix((total[at] - before) * back), U64(0)))
        return row, start, end, mix((total[end - 1] - before) * back), beginnings
