"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

Documents are dealt by ranges of doc_id, so files and their stripes follow ascending
ids. Every stripe can be read on its own, and the row index and the Bloom filter of
doc_id let a reader pass over stripes that lack an id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import output_path, small_batches, tidy, trim
from .tokenizing import word_encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 2
ENCODED = "shard int, doc_id long, begin long, n_tokens long, ids array<int>"


def _encode(name: str, end_id: int, piece: int = 1 << 22):
    def run(batches):
        encode, begin = word_encoder(name), 0
        for batch in batches:
            size = np.cumsum(batch.column(3).to_numpy())
            cut = [0, *(np.flatnonzero(np.diff(size // piece)) + 1).tolist(), len(size)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids, n = encode(part.column(2))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(begin + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))],
                    ["shard", "doc_id", "begin", "n_tokens", "ids"],
                )
                begin += int(offsets[-1])
                trim()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes the ids of every row of ``docs`` (doc_id, text), each with ``end_id`` at
    its end, in ascending order of doc_id (null first; ties by text).

    Null text is empty and has the end id alone. Repeated rows are written each. No
    rows: a folder without rows. ``begin`` is a document's place in its shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text", F.octet_length("text").cast("long").alias("octets"))
    encoded = dealt.mapInArrow(tidy(_encode(vocabulary, end_id)), ENCODED)
    options = {
        "compression": "snappy",
        "orc.stripe.size": str(16 << 20),
        "orc.row.index.stride": "1000",
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    with small_batches(docs.sparkSession, 2000):
        encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files written by ``write_tokens``; a filter on
    doc_id reaches the stripes' indexes."""
    files = spark.read.schema(ENCODED).orc(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))  # one row a shard: as many as the write had partitions
    return files.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column(3)
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_digest(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs``, reads the files back and returns (doc_id, start, n_tokens,
    ids_crc32) from them."""
    spark = docs.sparkSession
    path = output_path(spark, "tokens-orc")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
