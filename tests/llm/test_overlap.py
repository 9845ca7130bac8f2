"""Interval overlap join against plain loops, and the registered query against its SQL on rows that hold every case."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from millrace.llm import registry
from millrace.llm.overlap import RELATIONS, relation_totals, sessions


def related(left, right):
    """What every pair contributes, by two loops."""
    out = defaultdict(lambda: [0, 0, 0])
    for id_, key, s, e in left:
        for k, a, b, digest in right:
            if k != key or key is None or s is None or (e is not None and a > e) or (b is not None and s > b):
                continue
            end = lambda x: float("inf") if x is None else x
            i, j = (s > a) - (s < a) + 1, (end(e) > end(b)) - (end(e) < end(b)) + 1
            row = out[id_, RELATIONS[i][j]]
            row[0] += 1
            row[1] = None if e is None and b is None else row[1] + min(end(e), end(b)) - max(s, a) + 1
            row[2] += digest
    return {(*k, *v) for k, v in out.items()}


def test_relations_equal_loops(spark):
    rng = random.Random(7)
    right, left = [], []
    for key in range(6):
        at = rng.randint(-5, 5)
        for _ in range(rng.randint(0, 40)):  # intervals that follow each other, in slots that they share
            end = at + rng.choice((0, 0, 0, 1, 3))
            right.append((key, at, None if rng.random() < 0.3 else end, rng.randint(0, 1 << 32)))
            at = end + rng.choice((0, 0, 1, 2))
    for i in range(400):
        s = rng.randint(-8, 40)
        left.append((i, rng.randint(0, 6), s, None if rng.random() < 0.3 else s + rng.choice((0, 0, 1, 2, 9))))
    left += [(900, None, 1, 2), (901, 1, None, 2)]
    right += [right[0]] * 3 + [(None, 1, 2, 3)]  # a repeated interval of one slot or open still follows itself
    right = [r for r in right if r != right[0] or r[1] == r[2] or r[2] is None]
    got = relation_totals(
        spark.createDataFrame([(*r, "clash") for r in left], "id long, key long, start long, end long, digest string"),
        spark.createDataFrame([(*r, 0) for r in right], "key long, start long, end long, digest long, id int"),
    )
    assert {tuple(r) for r in got.collect()} == related(left, right)
    assert {r[1] for r in related(left, right)} == {x for row in RELATIONS for x in row}


def test_intervals_that_end_before_they_start_and_empty_tables(spark):
    one = spark.createDataFrame([(1, 1, 5, 4)], "id long, key long, start long, end long")
    other = spark.createDataFrame([(1, 4, 6, 9), (1, 9, 8, 9)], "key long, start long, end long, digest long")
    assert relation_totals(one, other).count() == 0
    assert relation_totals(one.where("false"), other).count() == relation_totals(one.withColumn("end", F.lit(7).cast("long")), other.where("false")).count() == 0


def chained(rows, gap):
    """Sessions of (key, time, hit) by one loop over each key's sorted times."""
    times = defaultdict(dict)
    for key, t, hit in rows:
        if key is not None and t is not None:
            times[key][t] = times[key].get(t, False) or bool(hit)
    out = set()
    for key, of in times.items():
        first = last = None
        for t in [*sorted(of), None]:
            if last is not None and (t is None or t - last > gap):
                out.add((key, first, last, of[last]))
                first = None
            first, last = (t if first is None else first), t
    return out


def test_sessions_equal_a_loop(spark):
    rng = random.Random(3)
    start, rows = datetime(1969, 12, 31, 20), []
    for key in (1, 2, 3, None):
        at = 0
        for _ in range(500):
            at += rng.choice((0, 1, 1000, 299_999_999, 300_000_000, 300_000_001, 250_000_000, 100_000_000, 90_000_000_000))
            rows.append((key, start + timedelta(microseconds=at), rng.choice(("click", "view", None))))
    rows += [(3, start + timedelta(seconds=200 * i), "view") for i in range(3000)]  # one session over a week
    rows += [(1, None, "click")] + rows[:50]
    df = spark.createDataFrame([(*r, 0) for r in rows], "who long, ts timestamp_ntz, kind string, key int")
    micros = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = {tuple(r) for r in sessions(df, "who", "ts", F.col("kind") == "click").collect()}
    assert got == chained([(k, micros(t), h == "click") for k, t, h in rows], 300_000_000)
    assert sessions(df.where("false"), "who", "ts", F.col("kind") == "click").count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(11)
    day = datetime(2024, 1, 1)
    moment = lambda: day + timedelta(seconds=rng.randint(0, 6 * 86400))
    client = lambda: rng.choice((7, 7, 7, rng.randint(0, 9), None))
    clicks = [(i, rng.choice((None, moment(), moment(), moment())), client(), rng.choice(("click", "view", None))) for i in range(1500)]
    clicks += clicks[:100]
    sales = [(i, client(), rng.choice(("held", "done", None)), rng.choice((None, moment(), moment(), moment(), moment()))) for i in range(300)]
    lines = [(rng.choice((7, 7, rng.randint(0, 320), None)), rng.choice((None, moment()))) for _ in range(500)]
    spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, kind string").repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz").write.parquet(f"{tmp_path}/sale_lines.parquet")
    c = duckdb.connect()
    for name in ("clicks", "sales", "sale_lines"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["op11_overlap"](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['op11_overlap']}) x").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 300
    first = c.execute("SELECT min(epoch_us(ts)) FROM clicks").fetchone()[0]
    assert c.execute(f"WITH {registry._CRC_TABLE} SELECT {registry._crc(repr(str(first)))} FROM crc_table").fetchone()[0] == zlib.crc32(str(first).encode())
