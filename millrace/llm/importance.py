"""Importance resampling of documents towards a target distribution of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.order import with_rank
from millrace.llm.common import Scratch

#: Words, after lower-casing A-Z: runs of digits, lower-case letters and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of features, least words of a document that may be drawn, percentage drawn, seed of the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42


def bucket_rows(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per feature, repeats included: a run of 1 to 3 consecutive words, as its ``bucket``, beside the other columns of ``texts`` and ``n_words``.

    The word array is zipped with itself one and two places on, so each word brings its three runs,
    which are hashed outside of lambdas. Three rows per word; those without a run, and the three of a text without a word
    (or a null one), have a null bucket. ``text`` itself is not kept.
    """
    kept = [c for c in texts.columns if c != "text"]
    words = texts.select(*kept, F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("_w"))
    zipped = words.select(*kept, F.size("_w").alias("n_words"), F.expr("inline_outer(arrays_zip(_w, slice(_w, 2, size(_w)), slice(_w, 3, size(_w))))")).toDF(*kept, "n_words", "_1", "_2", "_3")
    runs = (F.col("_1"), F.concat("_1", F.lit(" "), "_2"), F.concat("_1", F.lit(" "), "_2", F.lit(" "), "_3"))
    return zipped.select(*kept, "n_words", F.explode(F.array(*[(F.crc32(r.cast("binary")) % buckets).cast("int") for r in runs])).alias("bucket"))


def gain_table(source: DataFrame, target: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """``bucket, gain`` for every bucket: how much more the target's texts use it than the source's, in thousandths of e-folds.

    Counts are added up map-side, so at most ``buckets`` rows leave a task; the table has ``buckets`` rows whatever the input.
    """
    counts = [scratch.keep(bucket_rows(t.select("text"), buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(n))) for t, n in ((source, "s"), (target, "t"))]
    totals = counts[0].agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s_all")).join(counts[1].agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t_all")))  # one row each
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").na.fill(0, ["s", "t"]).join(F.broadcast(totals))
    real = lambda c: F.col(c).cast("double")
    ratio = (real("t") + 1) * (real("s_all") + buckets) / ((real("s") + 1) * (real("t_all") + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths, from the hash of its id alone, so that a draw can be repeated; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """Draws ``percent`` of the documents without replacement, by weight towards the texts of ``target``.

    The gain table is joined by broadcast (its size is ``buckets`` rows), gains are summed per document map-side, and
    the drawn ranks come from a distributed sort of narrow rows with one offset per range.

    Texts are whole; a null text has no features, weight 0 and is not drawn, as any with fewer than ``least_words`` words.
    A document without an id has no noise, hence no score, and is not drawn. Repeated rows are documents of their own; their ties in
    score and id are broken in the order read. Empty tables give no rows, an empty target gains from the source's counts alone. Other columns are ignored.
    Returns ``doc_id, n_features, weight, score, rank`` of all rows, rank null where undrawn.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    gains = scratch.keep(gain_table(docs, target, buckets, scratch).coalesce(1))
    rows = bucket_rows(docs.select(F.col("doc_id").cast("long"), "text").withColumn("_row", F.monotonically_increasing_id()), buckets)
    weighed = (
        rows.join(F.broadcast(gains), "bucket", "left")
        .groupBy("_row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    )
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull()).select("_row", "doc_id", "score")
    draw = able.count() * percent // 100
    drawn = with_rank(able, F.desc("score"), F.asc("doc_id"), F.asc("_row")).where(F.col("rank") <= draw).select("_row", "rank")
    return scored.join(drawn, "_row", "left").select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`resample` of all documents towards the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
