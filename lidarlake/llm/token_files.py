"""Token ids in Parquet files: dictionary-encoded list columns, bounded row groups, page indexes.

Layout of a file: one row a document in ascending doc_id order with ``doc_id``, ``shard`` and ``shard_start``
(ids before it in its file), ``n_tokens`` and ``ids`` (list of int). Ids come from a small vocabulary, so the
list column is dictionary-encoded; doc_id is delta-encoded (version 2 pages). Row groups are bounded in bytes and pages in rows, and
Parquet's column and offset indexes are written, so that a filter on doc_id reads few pages of ``ids`` and
metadata queries read no ids at all.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import small
from lidarlake.llm.tokens import encoder as encoder_of

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


def _encode(batches, tokenizer: str, end: int):
    encoder, shard, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
    tail = np.array([end], "<u4").tobytes()
    for batch in small(batches):
        ids = [encoder(t) + tail for t in batch.column(1).to_pylist()]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts = start + np.concatenate([[0], np.cumsum(sizes)])
        start = int(starts[-1])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(starts[:-1], pa.int64()), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, values)],
            names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> None:
    """Encode ``docs(doc_id, text)`` and write token files in ascending doc_id order (nulls first).

    Null or empty text: only the end id. Rows with the same doc_id are all written, ordered by text.
    An empty table writes no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_encode, tokenizer=tokenizer, end=end), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Rows of token files; with ``ids=False`` only the metadata columns are read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if ids else df.drop("ids")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all shards before each; as many rows as shards, from metadata columns alone."""
    shards = read_tokens(spark, path, ids=False).groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("n"))
    # one row a shard: a window over all of them stays small
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))


def _digest(batches):
    for batch in batches:
        ids = batch.column(2)
        cuts, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        raw, base = memoryview(values).cast("B"), 0
        crc = [zlib.crc32(raw[4 * (a - base) : 4 * (b - base)]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(3)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of token files: doc_id, start, n_tokens, ids_crc32, from the ids as read back."""
    rows = read_tokens(spark, path).select("doc_id", F.col("shard_start").alias("start"), "ids", "shard")
    rows = rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    rows = rows.join(F.broadcast(shard_starts(spark, path)), "shard")  # as many rows as shards
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
