"""Importance resampling against plain loops and against its SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb

from millrace.llm import registry
from millrace.llm.importance import resample


def features(text, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets, least, percent):
    """(doc_id, n_features, weight, score, rank), by loops."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, buckets)[1])
    for text in target:
        t.update(features(text, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text, buckets)
        weight = sum(gain[b] for b in found)
        h = None if doc_id is None else int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def texts(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice(("Alpha", "beta", "É", "gamma7", "中文", "of", "x-y", "don't", "  ", "\n", "9", "Z" * 40))
    return [" ".join(pick() for _ in range(rng.choice((0, 1, 2, 3, 19, 20, 60, 300)))) for _ in range(n)]


def test_equals_loops(spark):
    docs = [(i, t) for i, t in enumerate(texts(1, 150))] + [(500, None), (501, ""), (None, "alpha " * 30), (3, "beta " * 20), (3, "beta " * 20), (502, "w " * 40_000)]
    target = [*texts(2, 20), None]
    frame = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id long, text string, bucket string, n_words int, gain int").repartition(3)
    goal = spark.createDataFrame([(t, "clash") for t in target], "text string, doc_id string")
    for percent in (5, 40, 100):
        got = [tuple(r) for r in resample(frame, goal, 97, 20, percent).collect()]
        assert sorted(got, key=repr) == sorted(plain(docs, target, 97, 20, percent), key=repr)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resample(frame.where("false"), frame).count() == 0
    (row,) = resample(frame, frame.where("false"), 50, 1, 100).collect()
    assert tuple(row) == plain([(1, "a b c " * 10)], [], 50, 1, 100)[0] and row["rank"] == 1


def test_query_equals_its_sql(spark, tmp_path):
    docs = [*enumerate(texts(5, 120)), (900, None), (901, "ÀÉ " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts(6, 9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["op12_resample"](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['op12_resample']}) x").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
