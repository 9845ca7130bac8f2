"""Exports whose tasks hold a bounded number of rows."""

from __future__ import annotations

from millrace.operators import facts, reports


def test_graph_export_in_bounded_parts(spark):
    rows = [("a", "write", "x"), ("a", "wrote", "x"), ("b", "is_a", None), (None, "is_a", "y"), ("c", None, "z")] + [(f"s{i}", "have", "o") for i in range(40)]
    t = spark.createDataFrame(rows + rows[:7], "sub string, rel string, obj string")
    bad = spark.createDataFrame([("a", "write", "x"), ("b", "is_a", None), (None, "is_a", "y"), ("s3", "have", "o"), ("none", "write", "x"), ("c", None, "z")], "sub string, rel string, obj string")
    out = facts.export_graph(t, bad, part_rows=5)
    got = {(r["s"], r["p"], r["o"]): r["consistent"] for r in out.collect()}
    assert len(got) == out.count() == 2 + 5 + 5 + 1 + 40 * 3
    assert {k for k, ok in got.items() if not ok} == {("a", "write", "x"), ("a", "wrote", "x"), ("s3", "have", "o"), ("s3", "has", "o"), ("s3", "had", "o")}
    # more rows, more parts; and no join whose sides a task would sort besides
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "11), REPARTITION_BY_NUM" in plan


def test_token_counts_by_chunks(spark):
    """Chunks are encoded once; counts are those of whole texts, odd white space and added tokens included."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert reports.by_chunks(whole.to_str()) and not reports.by_chunks(whole.to_str().replace('"add_prefix_space":false', '"add_prefix_space":true'))
    rng = random.Random(3)
    odd = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "don't", "'s", "word", "Wörter", "12", "3.5", "--", "<|endoftext|>", "漢字", "\u0301", "😀", "_"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(800)] + [None, "", " ", " a", "a ", "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in reports.token_counts(rows, path).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_cosine_pairs_a_few_rows_at_once(spark):
    import numpy as np

    from millrace.operators import topology

    assert topology.ROWS_AT_ONCE * (topology.BLOCK_VALUES // 64) * 8 <= 16 << 20  # a step's distances in blocks of 64 dimensions
    x = np.random.default_rng(5).normal(size=(300, 8))
    got = topology.cosine_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): 1 - float(u[i] @ u[j]) for i in range(300) for j in range(i + 1, 300) if 1 - float(u[i] @ u[j]) <= 0.3}
    assert {(r["a"], r["b"]) for r in got} == set(want) and all(abs(r["distance"] - want[r["a"], r["b"]]) < 1e-9 for r in got)
