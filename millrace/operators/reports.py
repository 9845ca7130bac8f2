"""Aggregations and reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import rounded
from millrace.functions.order import dealt_ranges

Z95 = 1.959963984540054
#: Before a single space between other characters.
SPACED = re.compile(r"(?<=\S)(?= \S)")
#: Chunks whose numbers of tokens a task remembers.
KNOWN_CHUNKS = 1 << 19


def source_report(docs: DataFrame, by: str = "source") -> DataFrame:
    """Documents and megabytes (2^20 bytes, three digits) by source."""
    return docs.groupBy(by).agg(F.count("*").alias("docs"), rounded(F.sum(F.octet_length("text")) / 1048576, 3).alias("mb"))


def discard_counts(judged: DataFrame, *by: str) -> DataFrame:
    """Counts of broken rules; an outer explode, since an inner one would judge every row once more to drop empty lists."""
    each = judged.select(*by, F.explode_outer("violations").alias("reason")).where("reason is not null")
    return each.groupBy(*by, "reason").agg(F.count("*").alias("n"))


def discards_by_source(judged: DataFrame, by: str = "source") -> DataFrame:
    """True counts of broken rules by source."""
    return discard_counts(judged, by)


def crawl_span(log: DataFrame, ts: str = "ts", cleaning_s: float = 0.0) -> DataFrame:
    """Seconds from the first to the last logged request, plus the cleaning time."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 if dict(log.dtypes)[ts].startswith("timestamp") else F.col(ts).cast("double")
    return log.agg((F.max(seconds) - F.min(seconds) + cleaning_s).alias("duration_s"))


def bigrams(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))
    pairs = F.when(F.size("_t") >= 2, F.zip_with(F.slice("_t", 1, F.size("_t") - 1), F.slice("_t", 2, F.size("_t") - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    return docs.select(key, toks.alias("_t")).select(key, F.explode(pairs).alias("bigram"))


def bigram_ratio(docs: DataFrame, *by: str, key: str = "doc_id") -> DataFrame:
    """Distinct over all bigrams within documents, six digits; 0 without any. Counted in two steps, so no task holds all bigrams."""
    joined = bigrams(docs.withColumn("_key", F.struct(key, *by)), "_key")
    per = joined.groupBy(*[F.col(f"_key.{b}").alias(b) for b in by], "bigram").agg(F.count("*").alias("n"))
    ratio = rounded(F.coalesce(F.count("*") / F.sum("n"), F.lit(0.0)), 6).alias("ratio")
    return per.groupBy(*by).agg(ratio) if by else per.agg(ratio)


def first_documents(docs: DataFrame, name: str, limit: int = 10_000) -> DataFrame:
    """The first documents by name: a top-k report's limit, not a sample."""
    return docs.orderBy(name).limit(limit)


def round_diversity(docs: DataFrame, round_id: int, name: str = "doc_id", limit: int = 10_000) -> DataFrame:
    """``round_id, ratio``: the bigram ratio of a round's first documents by name, one row to append to the log of rounds."""
    return bigram_ratio(first_documents(docs, name, limit), key=name).select(F.lit(round_id).alias("round_id"), "ratio")


def by_chunks(tokenizer: str) -> bool:
    """Whether a tokenizer, given as JSON, encodes a text piece by piece where single spaces stand between other characters: byte-level BPE, and nothing that looks across them."""
    t = json.loads(tokenizer)
    pre = t["pre_tokenizer"] or {}
    plain = t["model"]["type"] == "BPE" and not t["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in t["added_tokens"])
    return bool(plain and added)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``tokens, words`` of every whole text instead of it: ids by a tokenizer's file, and white-space words. A null text has none of either.

    Where the tokenizer allows it (:func:`by_chunks`), a chunk between single spaces is encoded once and then counted from a table of bounded size.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cuts = (lambda x: [c for c in SPACED.split(x) if c]) if by_chunks(tokenizer.to_str()) else (lambda x: [x])
        known: dict[str, int] = {}
        for texts in batches:
            chunks = [cuts(t or "") for t in texts]
            new = list({c for of in chunks for c in of} - known.keys())
            found = dict(zip(new, (len(e) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            yield pd.Series([sum(known[c] if c in known else found[c] for c in of) for of in chunks], dtype="int64")
            # long chunks and whole texts hardly come again
            known.update((c, n) for c, n in found.items() if len(c) <= 64)
            if len(known) > KNOWN_CHUNKS:
                known.clear()

    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+", -1), lambda x: x != "")).cast("long")
    return docs.select(*[c for c in docs.columns if c not in ("text", "tokens", "words")], count("text").alias("tokens"), words.alias("words"))


def fertility(tokens: Column, words: Column) -> Column:
    """Tokens per word; infinite without words. Both are aggregates."""
    return F.when(words > 0, tokens / words).otherwise(F.lit(float("inf")))


def perplexity(nll: Column, tokens: Column) -> Column:
    """exp of summed loss over summed tokens; an error without tokens. Both are aggregates."""
    return F.when(tokens > 0, F.exp(nll / tokens)).otherwise(F.raise_error(F.lit("no tokens to evaluate")).cast("double"))


def quotient(part: Column, whole: Column) -> Column:
    """``part / whole`` as IEEE 754 has it, in doubles: infinite, or NaN for 0 / 0, where plain division by zero is an error."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole == 0, part * F.pow(whole, F.lit(-1.0))).otherwise(F.try_divide(part, whole))


def relative_gain(candidate: Column, champion: Column) -> Column:
    return quotient(champion - candidate, champion)


def delta_percent(new: Column, old: Column) -> Column:
    return quotient(new - old, old) * 100


def running_min(rows: DataFrame, value: str, run: str, order: str, name: str = "baseline") -> DataFrame:
    """Least positive value so far in each run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.min(F.when(F.col(value) > 0, F.col(value))).over(w))


def percentiles(rows: DataFrame, by: str, value: str, share: float = 0.95, name: str = "percentile", parts: int | None = None) -> DataFrame:
    """``by, name``: the exact percentile of each group, with linear interpolation between the two order statistics beside it.

    Ranges of (group, value) are sorted in parallel; a value's rank follows from its place in its range and one row
    per range and group, so no task holds a group's values, however many they are. Nulls are ignored, a null group is a group.
    """
    dealt = dealt_ranges(rows.select(by, F.col(value).cast("double").alias("_v")).where("_v is not null"), [by, "_v"], parts)
    runs = dealt.groupBy("_part", by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of_group = Window.partitionBy(by)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    placed = runs.select(F.col("_part").alias("_p"), F.col(by).alias("_g"), "_first", before.alias("_before"), ((F.sum("_n").over(of_group) - 1) * F.lit(share)).alias("_want"))
    joined = dealt.join(placed, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_g")))
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    near = joined.where((rank == F.floor("_want")) | (rank == F.ceil("_want"))).withColumn("_rank", rank)
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    part = F.first("_want") - F.floor(F.first("_want"))
    return near.groupBy(by).agg((low * (1 - part) + high * part).alias(name))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) without trials."""
    n = total.cast("double")
    p = successes / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    spread = (z / denom) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + spread)).otherwise(1.0)


def divergence_table(topo: DataFrame, decisions: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run and round of either log: kind, verdicts, divergence ("missing" where a side is), damage."""
    t = topo.select(run, "round_id", "stress_mode", "establish_baseline", "veto", F.lit(True).alias("_t"))
    d = decisions.select(run, "round_id", "ns_promote", "damage_classification", F.lit(True).alias("_d"))
    j = t.join(d, [run, "round_id"], "full_outer")
    text = lambda c: F.when(c, "True").otherwise("False")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select(
        run,
        "round_id",
        F.when(yes("establish_baseline"), "baseline").otherwise(F.coalesce("stress_mode", F.lit("normal"))).alias("kind"),
        F.when(F.col("_d").isNull(), "missing").otherwise(text(yes("ns_promote"))).alias("ns"),
        F.when(F.col("_t").isNull(), "missing").otherwise(text(yes("veto"))).alias("topo"),
        F.when(F.col("_d").isNull() | F.col("_t").isNull(), "missing").otherwise(text(yes("ns_promote") & yes("veto"))).alias("divergence"),
        F.when(F.col("_d").isNull(), "missing").otherwise(F.coalesce("damage_classification", F.lit("pending"))).alias("damage"),
    )


def divergence_rates(topo: DataFrame, decisions: DataFrame, run: str = "run_id", z: float = Z95) -> DataFrame:
    """Divergences over measured rounds by arm, without baselines, and their Wilson interval."""
    t = topo.where(~F.coalesce("establish_baseline", F.lit(False))).withColumn("arm", F.when(F.col("stress_mode").isNull(), "normal").otherwise("stress"))
    j = t.select(run, "round_id", "arm", "veto").join(decisions.select(run, "round_id", "ns_promote"), [run, "round_id"], "left")
    g = j.groupBy("arm").agg(F.count_if(F.coalesce(F.col("ns_promote") & F.col("veto"), F.lit(False))).alias("divergences"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("divergences"), F.col("n"), z)
    return g.select("arm", "divergences", "n", rounded(lo, 6).alias("lo"), rounded(hi, 6).alias("hi"))


def relation_histogram(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("sub").alias("subjects"), F.count_distinct("obj").alias("objects"))


def crawl_summary(log: DataFrame) -> DataFrame:
    """Attempted, fetched (200), skipped (-1) and failed requests."""
    fetched, skipped = F.count_if(F.col("status") == 200), F.count_if(F.col("status") == -1)
    return log.agg(F.count("*").alias("attempted"), fetched.alias("fetched"), skipped.alias("skipped"), (F.count("*") - fetched - skipped).alias("failed"))


def parameter_count(profiles: DataFrame) -> DataFrame:
    """Parameters of a decoder with grouped attention, gated feed-forward and tied embeddings, from its profile columns."""
    head = F.col("d_model") / F.col("n_heads")
    attention = F.col("d_model") * (F.col("d_model") + 2 * F.col("n_kv_heads") * head) + F.col("d_model") * F.col("d_model")
    per_layer = attention + 3 * F.col("d_model") * F.col("d_ff") + 2 * F.col("d_model")
    return profiles.withColumn("parameters", (F.col("vocab") * F.col("d_model") + F.col("n_layers") * per_layer + F.col("d_model")).cast("long"))
