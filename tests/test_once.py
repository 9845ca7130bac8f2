"""What is costly is worked out once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import quality
from millrace.functions.order import keep_top_share
from millrace.operators import facts, splits


def seen(spark):
    """An accumulator, and a column function that counts the rows that it is evaluated for."""
    rows = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        rows.add(1)
        return x

    return rows, counted.asNondeterministic()


def test_top_share_works_its_rows_out_once(spark):
    rows, counted = seen(spark)
    df = spark.range(100).select("id", counted("id").alias("score"))
    kept = keep_top_share(df, 0.8, F.desc("score"), F.col("id"), key="id")
    assert sorted(r["id"] for r in kept.collect()) == list(range(20, 100))
    assert rows.value == 100


def test_mean_word_length_takes_no_text_apart_by_what_is_no_word(spark):
    texts = ["", "a", "It's 12, ok\U0001f600ok", "...", "é à", "x" * 50 + "\n" + "y'", None]
    want = []
    for t in texts:
        words = re.findall(r"[A-Za-z']+", t or "")
        want.append(sum(map(len, words)) / len(words) if words else 0.0)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = df.select("k", quality.mean_word_len(F.col("text")).alias("m"))
    assert [r["m"] for r in got.orderBy("k").collect()] == want
    assert "regexp_replace" not in got._jdf.queryExecution().analyzed().toString()


def test_corpus_triplets_search_texts_once(spark):
    rows, counted = seen(spark)
    docs = spark.createDataFrame([(k, f"The cat{k} is a bird. Anna wrote the book.") for k in range(40)], "doc_id long, text string")
    held = spark.createDataFrame([("The cat3 is a bird. Anna wrote the book.",)], "text string")
    marked = docs.withColumn("n", counted("doc_id")).where("n >= 0").select("doc_id", "text")
    out = facts.extract_corpus(marked, held)
    assert sorted(r["ord"] for r in out.collect()) == list(range(1, out.count() + 1)) and out.where("sub = 'cat3'").count() == 0
    assert rows.value == 40
    assert facts.corpus_stats(out).first() == facts.corpus_stats(facts.corpus_facts(docs, held)).first()


def test_packing_makes_tokens_once(spark):
    rows, counted = seen(spark)
    d = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "ord long, text string")
    w = splits.pack(d, 8, "ord", end=1, tokens=F.array(counted("ord").cast("int"), F.lit(7)))
    assert [x for r in w.orderBy("window_id").collect() for x in r["tokens"]] == [x for k in range(40) for x in (k, 7, 1)]
    assert rows.value == 40
