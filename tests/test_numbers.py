"""Percentiles by ranges and projections at a bad condition."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.numbers import rounded
from millrace.operators import dedup, gates, reports, topology


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": 3000, "few": 21, "two": 2, "one": 1, None: 50}
    rows = [(g, float(v), "clash") for g, n in groups.items() for v in rng.integers(0, 90, n) / 7] + [("one", None, ""), ("none", None, "")]
    frame = spark.createDataFrame(rows, "g string, v double, percentile string").repartition(5)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["percentile"] for r in reports.percentiles(frame, "g", "v", share, parts=9).collect()}
        assert got.keys() == groups.keys()
        for g, v in got.items():
            assert v == pytest.approx(np.percentile([x for h, x, _ in rows if h == g and x is not None], share * 100)), (g, share)
    assert reports.percentiles(frame.where("false"), "g", "v").count() == 0


def test_projection_keeps_small_directions(spark):
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    x = rng.standard_normal((400, 5)) * np.array([1, 1e-2, 1e-4, 1e-6, 1e-8]) @ turn
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>").repartition(6)
    got = np.array([r["v"] for r in topology.projected(points, 5).orderBy("vec_id").collect()])
    basis = np.linalg.svd(x, full_matrices=False)[2]
    basis *= np.sign(basis[np.arange(5), np.abs(basis).argmax(axis=1)])[:, None]
    want = x @ basis.T
    assert np.allclose(got / np.abs(want).max(axis=0), want / np.abs(want).max(axis=0), atol=1e-5)
    fewer = topology.projected(points.limit(2), 5).collect()
    assert len(fewer) == 2 and len(fewer[0]["v"]) == 5  # fewer points than dimensions


def test_gains_against_a_champion_at_zero(spark):
    inf = float("inf")
    rows = [(1.0, 0.0), (0.0, 0.0), (0.0, -0.0), (1.0, -0.0), (9.0, 10.0), (None, 0.0), (1.0, None)]
    frame = spark.createDataFrame(rows, "ppl double, champ double").coalesce(1)
    got = [tuple(r) for r in frame.select(reports.relative_gain(F.col("ppl"), F.col("champ")), reports.delta_percent(F.col("ppl"), F.col("champ"))).collect()]
    duck = duckdb.connect().execute("SELECT (c - p) / c, (p - c) / c * 100 FROM (VALUES " + ", ".join(f"({'NULL' if p is None else p}::DOUBLE, {'NULL' if c is None else c}::DOUBLE)" for p, c in rows) + ") t(p, c)").fetchall()
    assert got[0] == (-inf, inf) and np.array(got, float) == pytest.approx(np.array(duck, float), nan_ok=True)


def test_promotion_against_a_champion_at_zero(spark):
    rows = [(1.0, 0.0), (0.0, 0.0), (9.0, 10.0), (9.99, 10.0)]
    frame = spark.createDataFrame([(p, c, 0.5, 0.5, "x", "x") for p, c in rows], "ppl double, champ_ppl double, diversity double, champ_diversity double, digest string, expected_digest string").coalesce(1)
    assert [r["promote"] for r in gates.promotion(frame).collect()] == [False, True, True, False]


def test_prefixes_come_from_rows_where_they_lie(spark):
    rng = np.random.default_rng(9)
    sets = {i: sorted({int(x) for x in rng.integers(-(1 << 62), 1 << 62, 7)} | {int(x) for x in rng.choice(12, 5)}) for i in range(60)} | {99: [5]}
    frame = spark.createDataFrame(list(sets.items()), "rep long, set array<long>").repartition(3)
    found = dedup.set_prefixes(frame, 0.8)
    df = {x: sum(x in v for v in sets.values()) for v in sets.values() for x in v}
    often = lambda x: (df[x] if df[x] >= dedup.COMMON_LEAST else 0, x)
    want = {(i, len(v), x) for i, v in sets.items() for x in sorted(v, key=often)[: len(v) - int(np.ceil(len(v) * 0.8 - 1e-9)) + 1]}
    assert {tuple(r) for r in found.collect()} == want
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    assert dedup.set_prefixes(frame.where("false"), 0.8).count() == 0


def test_rounding_is_that_of_sql_on_doubles(spark):
    pairs = [(57.63, 6.4), (1.0, 640.0), (513.0, 640.0), (-513.0, 640.0), (2.5, 1.0), (1e300, 1e-5), (1e308, 1e-300), (0.0, 0.0), (None, 1.0), (3.0, 0.0)]
    pairs += [(a / 100, b / 100) for a in range(1, 4000, 37) for b in range(10, 2000, 10)]
    con = duckdb.connect()
    con.execute("CREATE TABLE m (k INT, ppl DOUBLE, champ DOUBLE)")
    con.executemany("INSERT INTO m VALUES (?, ?, ?)", [(k, *p) for k, p in enumerate(pairs)])
    want = con.execute("SELECT round((champ - ppl) / champ, 6)::VARCHAR, round(ppl * champ, 2)::VARCHAR, round(ppl / champ, 9)::VARCHAR FROM m ORDER BY k").fetchall()
    m = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, ppl double, champ double").orderBy("k")
    got = m.select(rounded(reports.relative_gain(F.col("ppl"), F.col("champ")), 6).alias("a"), rounded(F.col("ppl") * F.col("champ"), 2).alias("b"), rounded(reports.quotient(F.col("ppl"), F.col("champ")), 9).alias("c")).collect()
    plain = lambda x: None if x is None else repr(float(x))
    assert [tuple(map(plain, r)) for r in got] == [tuple(map(plain, r)) for r in want]
    assert got[0]["a"] == -8.004687
