"""Sharding by jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, settle

#: Multiplier of the published algorithm's generator (Lamping and Veach, 2014).
_JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: going from n to n + 1 shards, a key stays or goes to shard n."""
    key = keys.astype(np.uint64).copy()
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = ahead < shards
    while moving.any():
        shard[moving] = ahead[moving]
        key[moving] = key[moving] * _JUMP + np.uint64(1)
        draw = ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = ahead < shards
    return shard


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Put rows into ``shards`` by their key: (key, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``key``: the key and the number of shards decide. ``grown_shard`` is the shard with one
    more of them; only rows that move into the new shard differ. ``size`` is the text's UTF-8 bytes plus
    ``overhead`` (null text: the overhead alone, CRC of nothing). ``slot`` numbers a shard's rows without
    gaps: rows count up inside each task's part of a shard, and the parts follow one another. Part sizes
    are one row for each task and shard, so no shard is gathered anywhere.

    Repeated rows are rows of their own, in the same shard. Null keys share one shard. An empty table gives
    an empty result; further columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("_hash"),
        F.spark_partition_id().alias("_part"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(shards, np.int64)
        for batch in batches:
            hashes = batch["_hash"].to_numpy().astype(np.uint64)
            shard = jump_hash(hashes, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            slot = np.empty(len(shard), np.int64)
            slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(used, counts)
            used += counts
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["size"], batch["text_crc32"], batch["_part"], *map(pa.array, (shard.astype(np.int32), slot, jump_hash(hashes, shards + 1).astype(np.int32)))],
                ["doc_id", "size", "text_crc32", "_part", "shard", "_slot", "grown_shard"],
            )

    kind = docs.schema[key].dataType.simpleString()
    placed = settle(in_batches(rows, place, f"doc_id {kind}, size bigint, text_crc32 bigint, _part int, shard int, _slot bigint, grown_shard int"))
    parts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_slot")).alias("slot"), "grown_shard"
    )
