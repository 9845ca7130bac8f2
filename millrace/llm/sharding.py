"""Contiguous shards of near-equal bytes, by global prefix sums."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches

#: Number of shards of the query, and bytes counted for a document besides its text.
SHARDS, OVERHEAD = 40, 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, scratch: Scratch | None = None) -> DataFrame:
    """Shard of every row by the ``bytes`` law: rows in the order read, cut where the running size passes equal targets.

    Sizes are taken in one scan and kept (no text) with the row's partition and place. Totals of the
    partitions, one row each, give every partition its offset on the driver; a row belongs to the
    shard in which the middle of its bytes falls, so no group of rows can crowd a shard and shards
    differ by at most one document. A null text counts as empty, with size ``overhead``; repeated
    rows are placed each; an empty table gives no rows. Other columns of ``docs`` are ignored.
    Returns ``doc_id, size, text_crc32, shard, slot``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    totals = sized.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place").alias("place")).orderBy("part").collect()
    total = sum(t["size"] for t in totals)
    starts, rows, at = {}, 0, 0
    for t in totals:
        starts[t["part"]] = (at, rows)
        at, rows = at + t["size"], rows + t["n"]
    offsets = spark.sparkContext.broadcast(starts)  # one pair per partition

    # Readers may split or join the kept files, so rows (without texts) are dealt back to their partition and order.
    ordered = sized.repartition("part").sortWithinPartitions("part", "place")

    def place(batches):
        part, size_sum, count = None, 0, 0
        for b in batches:
            parts, size = b.column("part").to_numpy(), b.column("size").to_numpy()
            shard, rank = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    part = parts[lo]
                    size_sum, count = offsets.value[int(part)]
                run = size_sum + np.cumsum(size[lo:hi])
                middle = run - size[lo:hi] // 2
                shard[lo:hi] = np.minimum(shards - 1, middle * shards // total)
                rank[lo:hi] = count + np.arange(hi - lo)
                size_sum, count = int(run[-1]), count + hi - lo
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(rank)],
                ["doc_id", "size", "text_crc32", "shard", "rank"],
            )

    placed = scratch.keep(ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, rank long"))
    scratch.drop(sized)
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # a row per shard
    first = F.element_at(F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]), F.col("shard")) if firsts else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`shard_by_bytes` over the whole table, in 40 shards."""
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
