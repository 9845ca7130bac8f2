"""Registered queries with SQL on small tables that hold links, since the given ones hold few."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from millrace.llm import registry


def compare(spark, name, folder, table):
    got = registry.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]}) x").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows) == sorted(want)
    return [dict(zip(columns, r, strict=True)) for r in rows]


def test_op1_on_planted_links(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[100:160] = x[:60] + 0.1 * rng.standard_normal((60, 16))  # clear links
    x[160:200] = x[100:140] + 0.1 * rng.standard_normal((40, 16))  # and chains of them
    x[300:340] = x[7]  # equal rows
    rows = [(i, [float(y) for y in v], i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = compare(spark, "op1_neardup", tmp_path, "embeddings")
    assert sum(r["n_links"] > 0 for r in out) > 150 and sum(not r["kept"] for r in out) > 100


def test_op7_on_planted_copies(spark, tmp_path):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 300)}" for _ in range(70)]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(text))
    texts += [texts[0], texts[0].upper(), "", " \t", "one", "ONE", "one two", None, "a\x0bb\x0cc", "é É"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = compare(spark, "op7_minhash", tmp_path, "documents")
    assert sum(not r["kept"] for r in out) > 30
