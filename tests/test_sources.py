"""Numbered lines, the paged stream, budgets by size classes and digest trees."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import splits
from millrace.sources import crawl, files


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = {}
    for name, n in (("a", 5000), ("b", 3), ("c", 2000)):
        texts[name] = [f"{name} {i} " + "x" * rng.randint(0, 60) for i in range(1, n + 1)]
        (tmp_path / f"{name}.txt").write_text("\n".join(texts[name]) + "\n" * (name != "b"))
    (tmp_path / "empty.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["file"][-5], r["line"], r["value"]) for r in got) == sorted((k, i, t) for k, lines in texts.items() for i, t in enumerate(lines, 1))


def test_a_bad_triplet_is_named_by_file_and_line(spark, tmp_path):
    good = json.dumps({"sub": "a", "rel": "is_a", "obj": "b", "conf": 0.5})
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.jsonl").write_text(f"{good}\n\n{good}\n")
    assert files.checked_triplets(spark, str(folder)).count() == 2
    (folder / "b.jsonl").write_text(f"{good}\n" * 700 + "\n" + json.dumps({"sub": "a", "rel": "r", "obj": "b"}) + f"\n{good}\nbroken\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        with pytest.raises(ValueError, match=r"b\.jsonl:702: no conf"):
            files.checked_triplets(spark, str(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_paged_stream_stops_and_resumes(spark, tmp_path):
    log = str(tmp_path / "log")
    (tmp_path / "log").mkdir()

    def page(start, n):
        import os
        import uuid

        with open(os.path.join(log, f"{start}-{uuid.uuid4().hex}"), "w"):
            return [("arxiv", f"http://x/{i}") for i in range(start, start + n)]

    crawl.register(spark, page)
    seen = tmp_path / "out"

    def run(count, limit):
        stream = spark.readStream.format("millrace_paged").option("count", count).option("batch", 7).option("pages", 2).load()
        batches = []
        query = stream.writeStream.foreachBatch(lambda df, k: (batches.append(k), df.write.mode("overwrite").parquet(f"{seen}/batch={k}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(600):
                if query.exception() is not None:
                    raise query.exception()
                if len(batches) >= limit:
                    break
                query.awaitTermination(0.2)
            query.processAllAvailable()
        finally:
            query.stop()

    run(30, 1)
    run(65, 3)  # more items since
    urls = [r["url"] for r in spark.read.parquet(str(seen)).collect()]
    assert sorted(urls) == sorted(f"http://x/{i}" for i in range(65))
    starts = sorted(int(p.name.split("-")[0]) for p in (tmp_path / "log").iterdir())
    assert len(starts) == len(set(starts))  # no page twice


@pytest.mark.parametrize("sizes", [(1, 400), (0, 3), (1, 100_000)])
def test_budget_rounds_equal_a_loop(spark, sizes):
    rng = random.Random(sum(sizes))
    data = [(f"f{i}", rng.choice((rng.randint(*sizes), rng.randint(*sizes) // 9))) for i in range(250)] + [("null", None)]
    frame = spark.createDataFrame(data, "name string, bytes long")
    order = sorted((d for d in data if d[1] is not None), key=lambda x: (hashlib.md5(f"3:{x[0]}".encode()).hexdigest(), x[0]))
    for budget in (0, 1, 777, sizes[1] * 20):
        left, want = budget, set()
        for name, n in order:
            if n <= left:
                want.add(name)
                left -= n
        assert {r["name"] for r in splits.budgeted(frame, budget, 3, parts=7).collect()} == want, budget


def test_digest_tree_finds_the_changed_byte(spark):
    rows = [(f"d{i}", f"text {i}") for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "name string, content string").repartition(5)
    tree = splits.digest_tree(frame(rows))
    root = tree.where("level = 0").first()
    assert root["files"] == 300 and root["digest"] == splits.parallel_digest(frame(rows[::-1]))
    other = splits.digest_tree(frame([*rows[:17], ("d17", "text 18"), *rows[18:]]))
    assert [r["prefix"] for r in splits.changed_ranges(tree, other).collect()] == [hashlib.sha256(b"d17").hexdigest()[:2]]
    assert splits.changed_ranges(tree, splits.digest_tree(frame(rows[::-1]))).count() == 0
    lost = splits.changed_ranges(tree, splits.digest_tree(frame(rows[:-1])))
    assert [r["prefix"] for r in lost.collect()] == [hashlib.sha256(b"d299").hexdigest()[:2]]
    with pytest.raises(ValueError):
        splits.parallel_digest(frame(rows).where("false"))
    # by hand: leaves of a range in order of names, then ranges in order
    leaves = {}
    for name, text in sorted(rows):
        leaf = hashlib.sha256(name.encode() + b"\0" + hashlib.sha256(text.encode()).digest()).hexdigest()
        leaves.setdefault(hashlib.sha256(name.encode()).hexdigest()[:2], []).append(leaf)
    level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in leaves.items()}
    for k in (1, 0):
        up = {}
        for prefix in sorted(level):
            up.setdefault(prefix[:k], []).append(level[prefix])
        level = {p: hashlib.sha256("".join(v).encode()).hexdigest() for p, v in up.items()}
    assert level[""] == root["digest"]


def test_a_changed_holdout_names_its_range(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " * 3) for i in range(60)], "doc_id long, text string")
    path = str(tmp_path / "h")
    splits.freeze(docs, path, 0.2)
    stored = spark.read.parquet(f"{path}/holdout").collect()
    first = stored[0]["doc_id"]
    changed = spark.createDataFrame(stored).withColumn("text", F.when(F.col("doc_id") == first, F.lit("other")).otherwise(F.col("text")))
    changed.write.mode("overwrite").parquet(f"{path}/holdout")
    with pytest.raises(RuntimeError, match=f"changed: {hashlib.sha256(str(first).encode()).hexdigest()[:2]}"):
        splits.freeze(docs, path, 0.2)


def test_probes_are_written_once(spark, tmp_path):
    path = str(tmp_path / "p")
    sentence = lambda i: f"number {i} of the sentences has these many words in it."
    docs = spark.createDataFrame([(" ".join(sentence(i) for i in range(k, k + 12)),) for k in range(0, 60, 6)] + [(" ".join(["far"] * 300) + ".",), (None,), ("too short.",)], "text string")
    with pytest.raises(RuntimeError):
        splits.load_probes(spark, path)
    made = splits.create_probes(docs, path, 20, 7)
    stored = [r["sentence"] for r in splits.load_probes(spark, path).collect()]
    assert len(stored) == 20 == len(set(stored)) and stored == sorted(stored) and {*stored} <= {sentence(i) for i in range(70)}
    assert made["sha256"] == hashlib.sha256("\n".join(stored).encode()).hexdigest() and made["candidates"] == 66 and made["discarded_overlong"] == 1
    assert splits.create_probes(docs.limit(1), path, 5, 8) == made  # nothing is chosen anew
    spark.createDataFrame([(0, "other")], "ord int, sentence string").write.mode("overwrite").parquet(f"{path}/sentences")
    with pytest.raises(RuntimeError):
        splits.create_probes(docs, path, 20, 7)
    with pytest.raises(Exception, match="too few"):
        splits.create_probes(docs, str(tmp_path / "q"), 500, 7)
