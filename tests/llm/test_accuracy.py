"""Learned operators: against plain computations on small tables, and on held-out rows of the given ones."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, quality, registry

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def text_of(rng, good):
    return " ".join(f"w{rng.randint(0, 300)}" if good or rng.random() < 0.6 else "#$%" + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 60))) + (". " if good else "")


def test_quality_equals_a_plain_fit(spark):
    rng = random.Random(3)
    texts = [text_of(rng, i % 2) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    part = {r["id"]: r["p"] for r in spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("p")).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.assess(docs, labels).collect()}
    x, y = np.array([quality.statistics(t) for t in texts]), np.arange(400) % 2
    own = np.array([part[i] for i in range(300)])
    model = quality.Quality(x[:300].mean(axis=0), np.sqrt(np.maximum((x[:300] ** 2).mean(axis=0) - x[:300].mean(axis=0) ** 2, 1e-12)))
    z = model.features(x[:300][own != 0])
    penalty = quality.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(z.T @ z + penalty, z.T @ y[:300][own != 0])
    raw = model.raw(x)
    bins = np.clip(((raw[:300][own == 0] + 1) / 3 * quality.SCORE_BINS).astype(int), 0, quality.SCORE_BINS - 1)
    at = np.unique(bins)
    hits, counts = (np.bincount(bins, weights=w, minlength=quality.SCORE_BINS)[at] for w in (y[:300][own == 0], None))
    model.knots = quality.isotonic((at + 0.5) / quality.SCORE_BINS * 3 - 1, hits, counts.astype(float))
    assert np.allclose([got[i] for i in range(400)], model.score(x), atol=1e-6)


def test_random_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, len(quality.NAMES)))
    model = quality.Quality(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).mean() < 0.05


def test_isotonic_equals_a_plain_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 12)
        counts = rng.integers(1, 6, n).astype(float)
        hits = np.array([rng.integers(0, c + 1) for c in counts], float)
        at, values = quality.isotonic(np.arange(n, dtype=float), hits, counts)
        # the greatest lower, least upper mean
        mean = lambda i, j: hits[i : j + 1].sum() / counts[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        pools = sorted(set(np.round(want, 9)))
        assert np.allclose(values, pools, atol=1e-3) and (np.diff(at) > 0).all()


def test_without_a_calibrating_or_fitting_part_all_rows_do_both(spark):
    rng = random.Random(8)
    part = {r["id"]: r["p"] for r in spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("p")).collect()}
    for wanted in (0, 1):
        ids = [i for i in range(400) if (part[i] == 0) == (wanted == 0)][:80]
        docs = spark.createDataFrame([(i, text_of(rng, k % 2)) for k, i in enumerate(ids)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
        got = {r["doc_id"]: r["predicted"] for r in quality.assess(docs, labels).collect()}
        assert sum(got[i] == k % 2 for k, i in enumerate(ids)) >= 0.9 * len(ids)


def test_documents_with_equal_statistics_tie(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "same words here") for i in range(60)], "doc_id long, text string")
    got = {round(r["score"], 9) for r in quality.assess(docs, labels).collect()}
    assert len(got) == 1 and quality.good_documents(docs, labels).count() in (0, 60)
    assert quality.good_documents(docs, labels.limit(0)).count() == 60 and quality.good_documents(docs.limit(0), labels).count() == 0


def test_language_is_that_of_the_nearest_centroid(spark):
    rng = random.Random(4)
    vocabulary = {"aa": "river stone house green", "bb": "fluss stein haus grün", "cc": "río piedra casa verde"}
    rows = [(" ".join(rng.choice(words.split()) for _ in range(25)), lang) for lang, words in vocabulary.items() for _ in range(40)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert np.allclose(np.linalg.norm(model.matrix, axis=1), 1, atol=1e-5) and sorted(set(model.of.tolist())) == [0, 1, 2]
    for text, lang in rows[::7]:
        counts, _ = language.grams(text)
        v = np.sqrt(counts) * model.idf
        cosines = model.matrix @ v / (np.linalg.norm(model.matrix, axis=1) * np.linalg.norm(v))
        got, score, far = model.predict(text)
        assert got == lang == model.languages[model.of[cosines.argmax()]] and abs(score - cosines.max()) < 1e-5 and not far
    grams = np.array([language.grams(t)[0] > 0 for t, _ in rows]).sum(axis=0)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + grams)) + 1)


@tables
def test_language_of_held_out_rows(spark):
    out = registry.QUERIES["op4_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


@tables
def test_quality_of_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    held = registry.QUERIES["op9_quality"](spark, SF).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(held) > 40 and sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    order = sorted(held, key=lambda r: r["score"])
    good = sum(r["quality"] for r in held)
    wins = sum(sum(x["quality"] == 0 for x in order[:i]) for i, r in enumerate(order) if r["quality"])
    assert wins >= 0.95 * good * (len(held) - good)


@tables
def test_shards_are_near_equal(spark):
    out = registry.QUERIES["op8_sharding"](spark, SF)
    loads = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    largest = out.agg(F.max("size")).first()[0]
    assert len(loads) == 40 and all(r["m"] == r["n"] - 1 for r in loads) and max(r["b"] for r in loads) - min(r["b"] for r in loads) <= 2 * largest
