"""Shared plumbing of the training-data operators: shared-folder tables, components, batch limits."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import marked, with_keys, without_keys  # noqa: F401  for the operators
from millrace.lineage import shared_folder
from millrace.ship import ship

#: Rows and bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the text lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_tables: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Ready a session for Python workers: they get this package, and small Arrow batches, since one document may be very long.

    The bounds are the session's and the same for all operators, so plans that run later keep them.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """At the end of a task: gives memory that a worker holds but does not use back to the system, since workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive executors.

    ``keep`` returns the table re-read; ``drop`` deletes one that is no longer needed. What the
    returned plan still reads stays until the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        _tables.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._millrace_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_millrace_path", None):
                _delete(self.spark, t._millrace_path)


@atexit.register
def _forget() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone; the cluster's own clean-up remains
            return


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, component)`` per node, component the smallest reachable.

    Alternating large-star and small-star rounds; each keeps at most as many edges as before, so hubs
    never gather in one task: only minima (partially aggregated) and joins on the node are needed.
    """
    e = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def extended(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``(node, component)`` of the links behind ``comp`` and more ``links(a long, b long)``: only the new links between components are followed."""
    if links.limit(1).count() == 0:
        return comp
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    to = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    joined = scratch.keep(components(links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(of("a"), of("b")), scratch))
    lead = joined.select(F.col("node").alias("component"), F.col("component").alias("_lead"))
    grown = comp.join(lead, "component", "left").select("node", F.coalesce("_lead", "component").alias("component"))
    return grown.union(joined.join(comp.select("node"), "node", "left_anti").select("node", "component"))


#: Stands for a null id in keys.
NO_ID = -(1 << 63)


def row_keys() -> list[Column]:
    """``did, th``, never null: the id, or NO_ID, and the hash of the text; they tell rows apart, but for those that repeat both."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("did"), F.xxhash64("text").alias("th")]
