"""Token ids of documents in Parquet files that can be read in parts.

A file holds documents in ascending doc_id, one row each: doc_id, shard, start,
n_tokens and the list of ids. The ids are dictionary-encoded (a vocabulary fits a
dictionary page, so an id takes at most 16 bits before compression); the ascending
columns are delta-encoded. Row groups and pages have set sizes, and the writer adds
column and offset indexes, so that a reader of some doc_ids opens the pages that can
hold them, and a reader of lengths opens no ids at all.

Documents are dealt by range and sorted as texts; ids are made in that order and
written by the task that made them, so no ids are shuffled. ``start`` counts from the
start of the file; a manifest with one row for each file tells where the file starts
in the whole, and readers add the two.

Cases: a null or empty text gives the end id alone; rows without an id come first;
rows of one id are ordered by a hash of their text, and all are written; an empty
table gives no rows; further input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty
from fieldglass.llm.packing import word_cache

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1_000
#: Ids that a task sends to the writer at once.
OUT_IDS = 1 << 20

SCHEMA = "doc_id bigint, shard int, start bigint, n_tokens bigint, ids array<int>"
MANIFEST = "shard int, shard_start bigint, documents bigint, tokens bigint, least_doc_id bigint, most_doc_id bigint"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache, shard, at = word_cache(path), TaskContext.get().partitionId(), 0
    for batch in sliced(batches):
        docs = 0
        for starts, ids in cache.encode_arrow(batch.column(1)):
            n = len(starts) - 1
            starts = starts.astype(np.int64) + np.arange(n + 1)  # an end id after each document
            ids = np.insert(ids, starts[1:] - np.arange(1, n + 1), end_id)
            # whole documents, as few as hold OUT_IDS
            first = 0
            while first < n:
                last = min(n, int(np.searchsorted(starts, starts[first] + OUT_IDS)))
                lists = pa.ListArray.from_arrays(pa.array(starts[first : last + 1] - starts[first], pa.int32()), pa.array(ids[starts[first] : starts[last]]))
                yield record_batch({"doc_id": batch.column(0).slice(docs + first, last - first), "shard": [shard] * (last - first), "start": pa.array(at + starts[first:last]), "n_tokens": pa.array(np.diff(starts[first : last + 1])), "ids": lists}, SCHEMA)
                first = last
            at, docs = at + int(starts[-1]), docs + n


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``: ``tokens`` and ``manifest``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    # the row's place parts equal rows, of which there may be many
    keys = ["doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place")]
    ordered = rows.select(*keys, "text").repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    encoded = ordered.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, tokenizer_path, end_id), SCHEMA)
    layout = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
    } | {f"parquet.enable.dictionary#{column}": "false" for column in ("doc_id", "start", "n_tokens")}
    encoded.write.options(**{k: str(v) for k, v in layout.items()}).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    shards = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("shard")
    sizes = shards.agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least_doc_id"), F.max("doc_id").alias("most_doc_id"))
    before = F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one row for each file
    sizes.withColumn("shard_start", F.coalesce(before, F.lit(0))).select(*[f.split()[0] for f in MANIFEST.split(", ")]).coalesce(1).write.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, unless left out, ids.

    ``where`` is a condition over doc_id, shard and n_tokens; it reaches the scan, so
    row groups and pages that it excludes aren't read.
    """
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    tokens = tokens if where is None else tokens.filter(where)
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", "shard_start")
    found = tokens.join(files, "shard").withColumn("start", F.col("start") + F.col("shard_start"))
    return found.select("doc_id", "start", "n_tokens", *["ids"] * ids)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at, ids = lists.offsets.to_pylist(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        sums = [crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
