"""Readers and writers of the engine's stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import cut

TRIPLETS = "sub string, rel string, obj string, conf double, source_doc_hash string, triplet_id string, ord long"
CRAWL_LOG = "url string, status int, bytes long, ts double, note string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any that a pattern matches, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, source, content, modificationTime, text``: raw pages in a folder per source; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(f"{root}/*")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("source"), "content", "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that parse; blank and broken lines are skipped, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", wide, {"mode": "PERMISSIVE"}).alias("r"))
    return lines.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def strict_triplets(spark: SparkSession, path: str) -> DataFrame:
    """All triplets; a broken line fails the read, a missing file is empty, a missing document hash is blank."""
    if not exists(spark, path):
        return spark.createDataFrame([], TRIPLETS)
    rows = spark.read.schema(TRIPLETS).option("mode", "FAILFAST").json(path)
    return rows.withColumn("source_doc_hash", F.coalesce("source_doc_hash", F.lit("")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: the lines of text files with their numbers from 1, however files are split.

    Lines are numbered within their split, in the order read; splits of a file are counted, and each starts after those before it:
    one row per split is ordered, not one per line. Compressed files are one split.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = cut(spark.read.text(path).select(meta("file_path").alias("file"), meta("file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("before"))
    # a split is read by one task from its first line on, so places within it have no gap
    return lines.join(starts, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def checked_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Triplets in (sub, obj, confidence descending, id) order; blank lines are skipped.

    A line that is no JSON or lacks sub, obj or conf is an error at once that names the first such file and line. Lines are numbered only then.
    """
    schema = T.StructType.fromDDL(TRIPLETS).add("_corrupt_record", T.StringType())
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    absent = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in ("sub", "obj", "conf")]))
    bad = rows.where(broken | (F.size(absent) > 0))
    if bad.limit(1).count():
        found = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
        why = F.when(broken, F.lit("no valid JSON")).otherwise(F.concat(F.lit("no "), F.array_join(absent, ", ")))
        first = found.where(broken | (F.size(absent) > 0)).select("file", "line", "value", why.alias("why")).orderBy("file", "line").first()
        raise ValueError(f"bad triplet at {first['file']}:{first['line']}: {first['why']}: {first['value']}")
    return rows.select("r.*").drop("_corrupt_record").orderBy("sub", "obj", F.desc("conf"), "triplet_id")


def append_log(rows: DataFrame, path: str, format: str = "json") -> None:
    rows.write.mode("append").format(format).save(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Fails if the table is there already."""
    rows.write.mode("errorifexists").parquet(path)


def hash_index(spark: SparkSession, path: str) -> DataFrame:
    """Distinct hashes of earlier passes."""
    return tolerant_jsonl(spark, path, "hash string, source string, path string, chars long").select("hash").where("hash is not null").distinct()


def write_windows(windows: DataFrame, path: str) -> None:
    """Packed windows, sorted by id within files so that slices prune row groups."""
    windows.repartitionByRange("window_id").sortWithinPartitions("window_id").write.mode("overwrite").parquet(path)


def read_windows(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("window_id") >= start) & (F.col("window_id") < stop))


def cached_diagrams(spark: SparkSession, root: str, tensor_sha256: str, compute) -> DataFrame:
    """Diagrams stored under the hash of their tensor; computed and stored if absent."""
    path = f"{root}/tensor_sha256={tensor_sha256}"
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def promotion_log(metrics: DataFrame, required: tuple[str, ...]) -> str:
    """Markdown of a round's metrics; refuses a missing value."""
    rows = metrics.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("string")).otherwise(F.col(c).cast("string")).alias(c) for c in required]).collect()
    head = ["| " + " | ".join(required) + " |", "|" + "---|" * len(required)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"
