from __future__ import annotations

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import CleanConfig, GraphConfig
from millrace.functions.order import keep_top_share, with_rank, with_running_sum
from millrace.operators import dedup, facts, gates, graph, reports, sampling, splits, topology
from millrace.plans import logs
from millrace.sources import checkpoints, crawl, files
from millrace.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rank_and_running_sum(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    assert df.transform(lambda d: with_rank(d, F.desc("id"))).where("rank <> 1000 - id").count() == 0
    got = {r["id"]: r["before"] for r in with_running_sum(df, "v", "id").collect()}
    assert got[500] == sum(i % 7 for i in range(500))


def test_top_share_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("e", 0.5)], "k string, s double")
    assert [r[0] for r in rows(keep_top_share(df, 0.8, F.desc("s"), F.col("k"), key="k"))] == ["a", "b", "c", "d"]
    assert keep_top_share(df, 0.01, F.desc("s"), F.col("k"), key="k").count() == 1


def test_bands():
    assert dedup.best_bands(32, 0.8) == (3, 10)


def test_greedy_resolution_keeps_what_only_meets_dropped_rows(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert rows(dedup.first_inserted_wins(pairs)) == [(1, True), (2, False), (3, True), (4, False)]


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 50, 40)) for _ in range(6)]
    texts = base + [t + " extra" for t in base] + ["short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert [r[:2] for r in rows(dedup.similar_pairs(docs))] == want and want


def test_clean_pass(spark):
    text = lambda w: ("The " + w + " of the town is in the house and the people are by the river that we saw.\n") * 3 + f"It was the {w} that the man had with him and she was not there for all of it.\n"
    docs = spark.createDataFrame([(0, "s", text("old")), (1, "s", text("old")), (2, "s", "#$%& " * 60), (3, "s", "tiny"), (4, "s", text("completely different thing"))], "doc_id long, source string, text string")
    holdout = spark.createDataFrame([(0, "nothing here at all in this text")], "item_id long, text string")
    kept, reasons = dedup.clean(docs, holdout, None, CleanConfig(min_chars=100, keep_quantile=1.0))
    got = {r["reason"]: r["n"] for r in reasons.collect()}
    assert got["exact"] == 1 and got["length"] == 1 and got["symbol_ratio"] == 1
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [0, 4]


def test_reports(spark):
    one = spark.range(1)
    lo, hi = reports.wilson(F.lit(1), F.lit(3))
    r = one.select(lo.alias("lo"), hi.alias("hi")).first()
    assert round(r["lo"], 3) == 0.061 and round(r["hi"], 3) == 0.792
    with pytest.raises(Exception, match="no tokens"):
        one.select(reports.perplexity(F.lit(1.0), F.lit(0))).collect()
    docs = spark.createDataFrame([(0, "a b a b"), (1, "a b"), (2, "x")], "doc_id long, text string")
    assert reports.bigram_ratio(docs).first()[0] == 0.5
    assert reports.bigram_ratio(docs.limit(0)).first()[0] == 0.0


def test_holdout(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, content string")
    digest = splits.holdout_digest(f)
    assert digest == splits.holdout_digest(f.orderBy(F.desc("name")))
    assert splits.verify_holdout(f, digest) == digest
    with pytest.raises(RuntimeError):
        splits.verify_holdout(f, "0")
    with pytest.raises(ValueError):
        splits.holdout_digest(f.limit(0))


def test_replay(spark):
    d = spark.createDataFrame([(f"{i}.txt", i >= 6) for i in range(10)], "name string, fresh boolean")
    assert splits.replay(d, 0.5, 2, F.col("fresh")).count() == 7
    assert splits.replay(d, 1.0, 2, F.col("fresh")).count() == 10
    assert splits.replay(d, 0.0, 2, F.col("fresh")).count() == 4


def test_budget_skips_what_does_not_fit(spark):
    f = spark.createDataFrame([(str(i), 200) for i in range(4)] + [("big", 900)], "name string, bytes long")
    got = splits.budgeted(f, 500, 1)
    assert got.count() == 2 and got.where("name = 'big'").count() == 0


def test_pack_and_segments(spark):
    d = spark.createDataFrame([(0, [5, 6, 7]), (1, [8]), (2, [9, 10])], "ord long, tokens array<int>")
    w = splits.pack(d, 4, "ord", end=1).orderBy("window_id").collect()
    assert [r["tokens"] for r in w] == [[5, 6, 7, 1], [8, 1, 9, 10], [1, 0, 0, 0]]
    assert sum(sum(r["flags"]) for r in w) == 3
    s = splits.segments(splits.pack(d, 4, "ord", end=1)).orderBy("window_id").collect()
    assert s[1]["segments"] == [1, 1, 2, 2]


def test_learning_rate(spark):
    lr = lambda s: spark.range(1).select(splits.learning_rate(F.lit(s), F.lit(100), 1.0).alias("x")).first()["x"]
    assert lr(0) == 0.5 and lr(2) == 1.0 and abs(lr(100) - 0.1) < 1e-12


TRIPLETS = "sub string, rel string, obj string, conf double, source_doc_hash string, triplet_id string, ord long"


def test_conflicts_and_claims(spark):
    t = spark.createDataFrame([("x", "is_a", "bird", 0.9, "d1", "1", 1), ("x", "is_a", "fish", 0.7, "d2", "2", 2), ("x", "state", "alive", 0.9, "d3", "3", 3), ("x", "state", "dead", 0.9, "", "4", 4)], TRIPLETS)
    c, e = facts.class_conflicts(t), facts.exclusive_conflicts(t)
    assert [(r["obj_a"], r["obj_b"], r["conf_mean"]) for r in c.collect()] == [("fish", "bird", 0.8)]
    assert [r[0] for r in rows(facts.quarantine(c, e))] == ["d1", "d2", "d3"] == [r[0] for r in rows(facts.quarantine(c, facts.exclusive_sides(t)))]
    assert rows(facts.exclusive_sides(t)) == [("x", "state", "alive", "d3"), ("x", "state", "dead", "")] and tuple(facts.run_stats(t).first()) == (4, 2, 3)
    assert rows(facts.export_graph(t, c, e)) == rows(facts.export_graph(t, c, facts.exclusive_sides(t)))
    claims = spark.createDataFrame([(1, "x", "state", "dead"), (2, "x", "is_a", "tool"), (3, "y", "state", "dead"), (4, None, None, None)], "sentence_id long, sub string, rel string, obj string")
    assert rows(facts.claim_status(claims, t)) == [(1, "ok"), (2, "contradicts"), (3, "unverified"), (4, "ok")]


def test_regex_triplets(spark):
    d = spark.createDataFrame([(1, "The wolf is a mammal. The book was printed by Anna.")], "doc_id long, text string")
    assert ("wolf", "is_a", "mammal") in [(r["sub"], r["rel"], r["obj"]) for r in facts.extract(d).collect()]
    # relations are named by the verb's lemma
    assert ("anna", "print", "book") in [(r["sub"], r["rel"], r["obj"]) for r in facts.extract(d).collect()]
    d = spark.createDataFrame([(1, "Marie discovered a metal. Edison invented the lamp, it is as a sign. Nobody carries the box. Bob planned an exit.")], "doc_id long, text string")
    got = [(r["sub"], r["rel"], r["obj"], r["conf"]) for r in facts.extract(d).collect()]
    assert got == [("marie", "discover", "metal", 0.7), ("edison", "invent", "lamp", 0.7), ("nobody", "carry", "box", 0.7), ("bob", "plan", "exit", 0.7)]
    assert [tuple(r) for r in facts.extract_corpus(d, d.limit(0).withColumnRenamed("doc_id", "item_id")).select("sub", "ord").collect()] == [("marie", 1), ("edison", 2), ("nobody", 3), ("bob", 4)]
    assert facts.extract_corpus(d, d.withColumnRenamed("doc_id", "item_id")).count() == 0


def edges(spark, *e):
    return spark.createDataFrame([(u, "is_a", v, c, f"{u}{v}{c}") for u, v, c in e], "sub string, rel string, obj string, conf double, triplet_id string")


def test_cycles(spark):
    build = lambda *e: graph.build(edges(spark, *e))
    g = build(("a", "b", 0.9), ("b", "c", 0.95), ("c", "a", 0.9))
    assert [(r["path"], r["min_conf"]) for r in graph.cycles(g).collect()] == [(["a", "b", "c"], 0.9)]
    assert graph.triangles(g).first()[0] == 1
    assert graph.cycles(build(("a", "b", 0.9), ("b", "c", 0.9))).count() == 0
    assert graph.cycles(build(("a", "b", 0.9), ("b", "a", 0.9))).count() == 1
    assert graph.cycles(build(("a", "b", 0.9), ("b", "a", 0.5))).count() == 0
    assert graph.census(g, GraphConfig(max_cycles=1)).first()["truncated"] is True
    assert rows(graph.distances(build(("a", "b", 0.9), ("b", "a", 0.7))))[0][2] == pytest.approx(0.1)


def test_bottleneck_hand_values():
    d = lambda *p: np.array(p, float).reshape(-1, 2)
    assert topology.bottleneck(d((0, 1)), d((0, 0.6))) == pytest.approx(0.4)
    assert topology.bottleneck(d((0, 1)), d((0, 0.6), (0, 0.9))) == pytest.approx(0.3)
    assert topology.bottleneck(d((0, 1), (0, 3), (0, 5)), d((0, 4.5))) == pytest.approx(1.5)
    assert topology.bottleneck(d(), d((0, 1))) == pytest.approx(0.5) == topology.bottleneck(d((0, 1)), d())
    assert topology.bottleneck(d((0, math.inf)), d((0.2, math.inf))) == pytest.approx(0.2)


def test_rips(spark):
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    dist = np.sqrt(((square[:, None] - square[None]) ** 2).sum(axis=2))
    out = topology.rips_diagrams(dist)
    assert [(b, round(e, 6)) for k, b, e in out if k == 1] == [(1.0, round(math.sqrt(2), 6))]
    assert sum(k == 0 for k, _, _ in out) == 4
    pts = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.1, 0.0]), ("a", [10.0, 0.0])], "cloud_id string, x array<double>")
    g = topology.diagrams(pts, max_dim=0)
    assert topology.betti0(g, 1.0).first()["betti0"] == 2 and topology.betti0(g, 11.0).first()["betti0"] == 1


def test_gates(spark):
    m = spark.createDataFrame(
        [(9.8, 10.0, 0.8, 0.8, "x", "x"), (9.98, 10.0, 0.8, 0.8, "x", "x"), (9.8, 10.0, 0.56, 0.8, "x", "x"), (9.8, 10.0, 0.8, 0.8, "x", "y"), (9.8, None, 0.8, None, "x", "x"), (None, 10.0, 0.8, 0.8, "x", "x")],
        "ppl double, champ_ppl double, diversity double, champ_diversity double, digest string, expected_digest string",
    )
    assert [(r["promote"], r["abort"]) for r in gates.promotion(m.coalesce(1)).collect()] == [(True, False), (False, False), (False, False), (False, True), (True, False), (False, False)]
    v = spark.createDataFrame(
        [(2, True, 0.2, 0.0, 0.005, 4.0, 4.0, 4.0, 4.0), (2, True, 0.2, 0.0, 0.03, 4.0, 4.0, 4.0, 4.0), (2, True, 0.0, 0.0, 0.02, 1.0, 4.0, 4.0, 4.0), (2, True, 0.0, 0.0, 0.02, 4.0, 4.0, 6.0, 4.0), (2, True, 0.0, 0.0, 0.02, 4.0, None, 5.0, 4.0), (1, False, 0.9, 0.0, 0.0, 0.0, 4.0, 9.0, 4.0)],
        "round_id int, has_champion boolean, bottleneck_h0 double, bottleneck_h1 double, gain double, b0 double, baseline_b0 double, cycles double, champ_cycles double",
    )
    assert [r["causes"] for r in gates.topology_veto(v.coalesce(1)).collect()] == [["R1"], [], ["R2"], ["R3"], [], []]


def test_sampling(spark):
    p = spark.range(1).select(sampling.filtered_probabilities(F.array(*map(F.lit, (3.0, 2.0, 1.0, -1.0))), F.array().cast("array<int>"), top_k=2).alias("p")).first()["p"]
    assert p[2:] == [0.0, 0.0] and sum(p) == pytest.approx(1)


def test_sampling_equals_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.integers(-3, 4, int(rng.integers(1, 90)))]) for i in range(60)] + [(90, []), (91, None)]
    seen, penalty, temperature, k, top = {0, 2, 5}, 1.3, 0.6, 7, 0.8

    def plain(x):
        x = np.array([(v / penalty if v > 0 else v * penalty) if i in seen else v for i, v in enumerate(x)]) / temperature
        x[x < np.sort(x)[::-1][min(k, len(x)) - 1]] = -np.inf
        p = np.exp(x - x.max())
        p /= p.sum()
        order = np.lexsort((np.arange(len(p)), -p))
        p[order[np.concatenate([[0.0], np.cumsum(p[order])[:-1]]) > top]] = 0
        return p / p.sum()

    df = spark.createDataFrame(data, "id long, x array<double>")
    for r in df.select("id", "x", sampling.filtered_probabilities(F.col("x"), F.array(*map(F.lit, seen)), penalty, temperature, k, top).alias("p")).collect():
        assert r["p"] == (r["x"] if not r["x"] else pytest.approx(plain(r["x"]).tolist())), r["id"]


def test_sources(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps({"sub": "a", "rel": "is_a", "obj": "b", "conf": 0.5}) + "\nbroken\n")
    assert files.tolerant_jsonl(spark, str(path), files.TRIPLETS).count() == 1
    assert files.tolerant_jsonl(spark, str(tmp_path / "none"), files.TRIPLETS).count() == 0
    with pytest.raises(Exception):
        files.strict_triplets(spark, str(path)).collect()
    with pytest.raises(Exception, match="bad triplet"):
        files.checked_triplets(spark, str(path)).collect()


def test_robots(spark):
    urls = spark.createDataFrame([("http://a/x/y",), ("http://a/z",), ("http://b/x",), ("http://c/x",)], "url string")
    rules = spark.createDataFrame([("a", "/x", False), ("a", "/x/y", True), ("a", "/z", False)], "host string, prefix string, allow boolean")
    robots = spark.createDataFrame([("c", 403)], "host string, status int")
    assert [r[0] for r in rows(crawl.allowed(urls, rules, robots))] == ["http://a/x/y", "http://b/x"]


def test_ingest_is_incremental(spark, tmp_path):
    raw, store = tmp_path / "raw" / "site", str(tmp_path / "store")
    raw.mkdir(parents=True)
    text = " ".join(f"word{i}" for i in range(200)) + "."
    (raw / "a.raw").write_text(text)
    run = lambda: ingest.ingest(ingest.raw_stream(spark, str(tmp_path / "raw")), store, str(tmp_path / "cp")).awaitTermination()
    run()
    (raw / "b.raw").write_text(text)
    (raw / "c.raw").write_text(text + " more words")
    (raw / "d.raw").write_text(" ".join(f"other{i}" for i in range(200)) + ".")
    run()
    assert spark.read.parquet(f"{store}/documents").count() == 2


def test_ranks_and_sums_over_more_rows_than_the_range_sampler_reads(spark):
    n = 60_000
    rows = spark.range(0, n, 1, 6).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"), (F.col("id") % 7).alias("v"), F.sha1(F.col("id").cast("string").cast("binary")).alias("wide"))
    ranked = with_rank(rows, "h", "id", parts=8).agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("wide")).first()
    assert tuple(ranked) == (n, 1, n, n)
    last = with_running_sum(rows, "v", "h", "id", parts=8).agg(F.max(F.col("before") + F.col("v")), F.min("before"), F.count_distinct("wide")).first()
    assert tuple(last) == (sum(i % 7 for i in range(n)), 0, n)
    assert keep_top_share(rows, 0.3, "h", "id", key="id", parts=8).count() == round(0.3 * n)


def test_a_passage_in_a_long_document_is_contained(spark):
    item = " ".join(f"q{i}" for i in range(24))
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60))
    docs = spark.createDataFrame([(1, f"{long}\nfirst {item} last\n{long[::-1]}"), (2, long), (3, item), (4, " ".join(item.split()[:14]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short")], "item_id long, text string")
    assert rows(dedup.contained(docs, items, 0.8)) == [(1, 7, 1.0), (3, 7, 1.0)]
    assert rows(dedup.contamination(docs, items, 0.02).select("doc")) == [(3,), (4,)]


def test_diagrams_of_production_size(spark):
    ring = spark.createDataFrame([(f"n{i:03d}", f"n{(i + 1) % 800:03d}", 0.5) for i in range(800)], "a string, b string, distance double")
    out = topology.graph_diagrams(ring)
    assert rows(out.where("dim = 1")) == [(1, 0.5, 1.0)] and out.where("dim = 0").count() == 800
    turn = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    side = lambda k: 2 * math.sin(math.pi * k / 120)
    circle = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    dist = np.sqrt(((circle[:, None] - circle[None]) ** 2).sum(axis=2))
    long = [(b, d) for k, b, d in topology.rips_diagrams(dist) if k == 1 and d - b > 0.1]
    assert long == [(pytest.approx(side(1)), pytest.approx(side(40)))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clouds_are_of_production_size(spark):
    sizes = [r["count"] for r in logs._clouds(spark, "/root/testdata/sf0.001").groupBy("cloud_id").count().collect()]
    assert len(sizes) == 2 and max(sizes) - min(sizes) <= 1 and 100 < max(sizes) <= topology.MAX_POINTS


def test_a_long_chain_of_neighbours_is_decided(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(56)], "a long, b long").coalesce(1)
    assert rows(dedup.first_inserted_wins(chain)) == [(i, i % 2 == 0) for i in range(57)]


def test_entity_graph_refuses_what_exceeds_the_cap(spark):
    facts_ = [("a", "b"), ("c", "d"), ("e", "a"), ("e", "f"), ("a", "b"), ("c", "a"), ("e", "e")]
    t = spark.createDataFrame([(s, "is_a", o, 0.5, f"d{i}", str(i), i) for i, (s, o) in enumerate(facts_)], TRIPLETS)
    assert rows(facts.entity_graph(t, 3).select("sub", "obj", "facts", "docs")) == [("a", "b", 2, 2), ("e", "a", 1, 1), ("e", "e", 1, 1)]

    def plain(cap):
        nodes: set = set()
        for s, o in facts_:
            if len(nodes | {s, o}) <= cap:
                nodes |= {s, o}
        return nodes

    for cap in range(1, 9):
        assert {r["node"] for r in facts.capped_nodes(t, cap).collect()} == plain(cap), cap
    rng = np.random.default_rng(3)
    for _ in range(6):
        facts_ = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 25, (60, 2))]
        t = spark.createDataFrame([(s, "is_a", o, 0.5, "", str(i), i) for i, (s, o) in enumerate(facts_)], TRIPLETS)
        cap = int(rng.integers(2, 22))
        assert {r["node"] for r in facts.capped_nodes(t, cap).collect()} == plain(cap)
    assert facts.capped_nodes(t.limit(0), 3).count() == 0


def test_planted_triangles_have_distinct_corners(spark):
    t = spark.createDataFrame([(f"n{i}", "is_a", f"n{(i * 7 + 1) % 30}", 0.5, "", str(i), i) for i in range(60)], TRIPLETS)
    out = gates.contradiction_flood(t, 12, 5)
    sides = [r for r in out.collect() if r["planted"]]
    assert out.where("not planted").count() == 60 and len(sides) == 3 * gates.flood_size(12)
    corners: dict = {}
    for r in sides:
        assert r["sub"] != r["obj"]
        corners.setdefault(r["triplet_id"].rsplit("-", 1)[0], []).append((r["sub"], r["obj"]))
    assert all(len({x for s in c for x in s}) == 3 and {a for a, _ in c} == {b for _, b in c} for c in corners.values())
    assert gates.contradiction_flood(t.where("ord < 1"), 12, 5).where("planted").count() == 0


def test_claims_about_a_subject_with_many_objects(spark):
    t = spark.createDataFrame([("x", "state", f"o{i}", 0.9, "", str(i), i) for i in range(500)] + [("x", "state", "dead", 0.9, "", "z", 501), ("x", "is_a", "tool", 0.9, "", "y", 502)], TRIPLETS)
    claims = spark.createDataFrame([(1, "x", "state", "alive"), (2, "x", "state", "o7"), (3, "x", "state", None), (4, "x", "is_a", "tool"), (5, "x", "is_a", "food"), (5, "x", "is_a", "tool"), (6, "x", "is_a", "river")], "sentence_id long, sub string, rel string, obj string")
    assert rows(facts.claim_status(claims, t)) == [(1, "contradicts"), (2, "ok"), (3, "unverified"), (4, "ok"), (5, "contradicts"), (6, "unverified")]


def test_inventory_and_treatment_hashes(spark):
    files_ = spark.createDataFrame([(f"f{i}", i) for i in range(50)], "name string, bytes long")
    one = lambda df: gates.inventory_hash(df).first()[0]
    assert one(files_) == one(files_.repartition(7).orderBy(F.desc("name"))) != one(files_.where("name <> 'f3'"))
    assert one(files_) != one(files_.withColumn("bytes", F.when(F.col("name") == "f9", 10).otherwise(F.col("bytes"))))
    t = spark.createDataFrame([("a", "is_a", "b", 0.9, "d", "1", 1)], TRIPLETS)
    base = gates.treatment_hash(files_, "h", t, gates.treatment_manifest("normal", lr_multiplier=1))
    assert base == gates.treatment_hash(files_, "h", t, gates.treatment_manifest("normal", lr_multiplier=1))
    others = [
        gates.treatment_hash(files_, "g", t, gates.treatment_manifest("normal", lr_multiplier=1)), gates.treatment_hash(files_, "h", t.withColumn("conf", F.lit(0.8)), gates.treatment_manifest("normal", lr_multiplier=1)),
        gates.treatment_hash(files_, "h", t, gates.treatment_manifest("lr_spike", lr_multiplier=10)), gates.treatment_hash(files_, "h", t, gates.treatment_manifest("normal", lr_multiplier=1), files_),
        gates.treatment_hash(files_, "h", t, gates.treatment_manifest("normal", lr_multiplier=1), settings={"min_conf": 0.6}),
    ]
    assert len({base, *others}) == 6


def test_prompt_suite(spark):
    prompts = "array<struct<id: string, category: string, prompt: string, review_note: string, params: map<string, string>>>"
    suite = lambda version, p: spark.createDataFrame([(version, {"top_k": "40", "top_p": "0.9"}, p)], f"schema_version int, defaults map<string, string>, prompts {prompts}")
    good = [("a", "c", "p", "n", {"top_k": "5", "other": "1"}), ("b", "c", "p", "n", None)]
    assert {r["id"]: r["params"] for r in gates.checked_suite(suite(1, good)).collect()} == {"a": {"top_k": "5", "top_p": "0.9"}, "b": {"top_k": "40", "top_p": "0.9"}}
    for version, p, message in ((2, good, "version 2"), (1, [*good, good[0]], "prompt a: duplicate id"), (1, [("a", "c", "p", " ", None)], "prompt a: missing review_note")):
        with pytest.raises(ValueError, match=message):
            gates.checked_suite(suite(version, p))
    with pytest.raises(ValueError, match="lacks"):
        gates.checked_suite(suite(1, good).drop("defaults"))


def test_freezing_a_holdout_happens_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(24)], "doc_id long, text string")
    path = str(tmp_path / "frozen")
    first = splits.freeze(docs, path)
    assert first["status"] == "frozen" and first["docs"] == 1 and spark.read.parquet(f"{path}/rest").count() == 23
    assert splits.freeze(docs.limit(3), path) == {**first, "status": "already-frozen"}
    spark.createDataFrame([(99, "other", "x")], "doc_id long, text string, hash string").write.mode("append").parquet(f"{path}/holdout")
    with pytest.raises(RuntimeError, match="anchor"):
        splits.freeze(docs, path)
    with pytest.raises(ValueError):
        splits.freeze(docs.limit(0), str(tmp_path / "none"))
    import hashlib

    files_ = spark.createDataFrame([("b/x", bytearray(b"2")), ("a", bytearray(b"1"))], "name string, content binary")
    assert splits.holdout_digest(files_) == hashlib.sha256(b"a\0" + b"1" + b"b/x\0" + b"2").hexdigest() != splits.parallel_digest(files_)


def test_budget_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    data = [(f"f{i}", int(n)) for i, n in enumerate(rng.integers(1, 400, 300))]
    files_ = spark.createDataFrame(data, "name string, bytes long")
    import hashlib

    order = sorted(data, key=lambda x: (hashlib.md5(f"9:{x[0]}".encode()).hexdigest(), x[0]))
    for budget in (0, 50, 3000, 20_000, 10**6):
        left, want = budget, set()
        for name, n in order:
            if n <= left:
                want.add(name)
                left -= n
        assert {r["name"] for r in splits.budgeted(files_, budget, 9, parts=12).collect()} == want, budget


def test_pack_of_long_documents(spark):
    rng = np.random.default_rng(2)
    data = [(i, [int(x) for x in rng.integers(2, 99, int(n))]) for i, n in enumerate((0, 1, 7, 8, 9, 40, 0, 3, 17))]
    d = spark.createDataFrame(data, "ord long, tokens array<int>").repartition(3)
    for end in (1, None):
        flat = [(x, int(k == 0)) for _, t in data for k, x in enumerate([*t, *([end] if end else [])])]
        w = splits.pack(d, 8, "ord", end=end).orderBy("window_id").collect()
        padded = flat + [(0, 0)] * (-len(flat) % 8)
        assert [r["tokens"] for r in w] == [[x for x, _ in padded[i : i + 8]] for i in range(0, len(padded), 8)]
        assert [r["flags"] for r in w] == [[x for _, x in padded[i : i + 8]] for i in range(0, len(padded), 8)]
        s = splits.segments(splits.pack(d, 8, "ord", end=end)).orderBy("window_id").collect()
        assert [r["segments"] for r in s] == [np.cumsum(r["flags"]).tolist() for r in w]


def naive_diagrams(d):
    """Rips persistence by the textbook reduction of the whole boundary matrix."""
    n = len(d)
    simplices = [((i,), 0.0) for i in range(n)] + [((i, j), d[i, j]) for i in range(n) for j in range(i + 1, n)]
    simplices += [((i, j, k), max(d[i, j], d[i, k], d[j, k])) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
    simplices.sort(key=lambda s: (s[1], len(s[0]), s[0]))
    at = {s: i for i, (s, _) in enumerate(simplices)}
    low, paired, out = {}, set(), []
    columns = {}
    for i, (s, t) in enumerate(simplices):
        c = {at[s[:k] + s[k + 1 :]] for k in range(len(s))} if len(s) > 1 else set()
        while c and max(c) in low:
            c ^= columns[low[max(c)]]
        if c:
            low[max(c)], columns[i] = i, c
            paired |= {i, max(c)}
            born = simplices[max(c)]
            if t > born[1]:
                out.append((len(born[0]) - 1, born[1], t))
    out += [(len(s) - 1, t, math.inf) for i, (s, t) in enumerate(simplices) if i not in paired and len(s) < 3]
    return sorted((k, round(b, 9), round(e, 9)) for k, b, e in out if k < 2)


def test_diagrams_equal_the_textbook_reduction():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 12, 16):
        x = rng.standard_normal((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert sorted((k, round(b, 9), round(e, 9)) for k, b, e in topology.rips_diagrams(d)) == naive_diagrams(d)


def test_diagrams_do_not_depend_on_how_far_columns_look(monkeypatch):
    rng = np.random.default_rng(8)
    for n, dim in ((16, 3), (14, 40)):
        x = rng.standard_normal((n, dim))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for ahead in (1, 3, 8192):  # columns and their owners are worked out further, again and again
            monkeypatch.setattr(topology, "AHEAD", ahead)
            assert sorted((k, round(b, 9), round(e, 9)) for k, b, e in topology.rips_diagrams(d)) == naive_diagrams(d)


def test_bottleneck_equals_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(12):
        a, b = (np.sort(rng.random((rng.integers(0, 4), 2)), axis=1) for _ in range(2))
        # each side is filled up with the diagonal, which costs half a point's life, and nothing among itself
        best = math.inf
        size = len(a) + len(b)
        for p in permutations(range(size)):
            cost = 0.0
            for i, j in enumerate(p):
                left, right = (a[i] if i < len(a) else None), (b[j] if j < len(b) else None)
                if left is not None and right is not None:
                    cost = max(cost, np.abs(left - right).max())
                elif left is not None or right is not None:
                    one = left if left is not None else right
                    cost = max(cost, (one[1] - one[0]) / 2)
            best = min(best, cost)
        assert topology.bottleneck(a, b) == pytest.approx(best if size else 0.0)


def test_projection_and_self_noise(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    x -= x.mean(axis=0)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>").repartition(7)
    got = np.array([r["v"] for r in topology.projected(points, 2).orderBy("vec_id").collect()])
    basis = np.linalg.svd(x, full_matrices=False)[2][:2]
    basis *= np.sign(basis[np.arange(2), np.abs(basis).argmax(axis=1)])[:, None]
    assert np.allclose(got, x @ basis.T)
    g = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 0, 0.0, 1.2), (3, 0, 0.0, 1.6)], "cloud_id long, dim int, birth double, death double")
    assert topology.self_noise(g).first()["p95"] == pytest.approx(np.percentile([0.2, 0.4, 0.6], 95))


def test_census_stops_at_its_bound_of_work(spark):
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i in range(9) for j in range(9) if i != j]
    g = graph.build(edges(spark, *[(u, v, 0.9) for u, v in pairs]))
    whole = graph.census(g, GraphConfig()).first()
    assert whole["count"] == graph.cycles(g).count() == 36 + 168 + 756 + 3024 and whole["truncated"] is False
    part = graph.census(g, GraphConfig(max_work=1000)).first()
    assert part["truncated"] is True and 36 <= part["count"] < whole["count"]


def test_production_signatures_find_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(30)]
    near = [[w if rng.random() > 0.01 else f"y{rng.integers(9999)}" for w in b] for b in base]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + near)] + [(99, "too short")], "doc_id long, text string")
    bands = dedup.best_bands(128, 0.8)
    assert bands == (9, 13) or bands[0] * bands[1] <= 128
    sigs = dedup.signatures(docs, 128, 5)
    got = {tuple(r) for r in dedup.lsh_candidates(sigs, *bands).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in base + near]
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    alike = [(i, i + 30) for i in range(30) if share(i, i + 30) >= 0.9]
    assert len(alike) >= 10 and sum(p in got for p in alike) >= 0.9 * len(alike) and all(share(a, b) > 0.4 for a, b in got)
    sig = {r["doc_id"]: r["sig"] for r in sigs.collect()}
    assert 99 not in sig and all(len(x) == 128 for x in sig.values())
    estimate = np.mean([np.mean(np.array(sig[a]) == np.array(sig[b])) - share(a, b) for a, b in ((i, i + 30) for i in range(30))])
    assert abs(estimate) < 0.02


def test_equal_sets_are_one_class(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(40)] + [(50 + i, f"a b c d e f g h{i}") for i in range(2)] + [(90, "q r s")], "doc_id long, text string")
    members, sets = dedup.shingle_classes(docs)
    assert sets.count() == 3 and members.count() == 42
    assert dedup.similar_pairs(docs, 0.7).count() == 40 * 39 // 2 + 2 * 40 and dedup.similar_classes(sets, 0.7).count() == 2


def test_fetch_retries_and_stops(spark):
    def run(answers, retries=3):
        left, slept = list(answers), []

        def get(url):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        out = list(crawl.fetch("u", get, retries, sleep=slept.append, clock=lambda: 1.0))
        return [(r[0], r[3], r[4]) for r in out], slept

    assert run([(200, b"x")]) == ([(200, None, b"x")], [])
    assert run([TimeoutError(), (500, b""), (200, b"y")]) == ([(-1, "error:TimeoutError", None), (500, None, None), (200, None, b"y")], [2.0, 4.0])
    assert run([(429, b""), (200, b"y")]) == ([(429, None, None)], []) and run([(403, b"")])[0] == [(403, None, None)]
    assert run([(500, b"")] * 9, 0) == ([(500, None, None)], []) and len(run([(500, b"")] * 9, 5)[0]) == 5
    assert run([(500, b"")] * 9, 5)[1] == [2.0, 4.0, 8.0, 8.0]


def test_crawl_pass(spark):
    def get(url):
        return (200, url.encode()) if "ok" in url else (404, b"gone")

    urls = spark.createDataFrame([("s", "http://a/ok/1"), ("s", "http://a/no/2"), ("s", "http://b:8/ok/3"), ("s", "http://a/private/ok")], "source string, url string")
    rules = spark.createDataFrame([("a", "/private", False)], "host string, prefix string, allow boolean")
    log = crawl.crawl(urls, get, 1000.0, 2, rules, sleep=lambda s: None).collect()
    assert sorted((r["url"], r["status"], r["note"]) for r in log) == [("http://a/no/2", 404, None)] * 2 + [("http://a/ok/1", 200, None), ("http://a/private/ok", -1, "robots_disallowed"), ("http://b:8/ok/3", 200, None)]
    stored = crawl.pages(spark.createDataFrame([r for r in log if r["status"] == 200], crawl.LOG), "raw")
    assert {r["path"].rsplit("/", 1)[0]: bytes(r["content"]) for r in stored.collect()} == {"raw/a": b"http://a/ok/1", "raw/b_8": b"http://b:8/ok/3"}
    kept = ingest.prepared(stored, CleanConfig(min_chars=1))
    assert {r["text"] for r in kept.collect()} == {"http://a/ok/1", "http://b:8/ok/3"}
    with pytest.raises(ValueError):
        crawl.crawl(urls, get, 0)


def test_url_discovery(spark):
    ids = [r["id"] for r in crawl.sampled_ids(spark, 1, 1000, 20, 7).collect()]
    assert len(set(ids)) == 20 and ids == [r["id"] for r in crawl.sampled_ids(spark, 1, 1000, 20, 7).collect()] != [r["id"] for r in crawl.sampled_ids(spark, 1, 1000, 20, 8).collect()]
    urls = spark.createDataFrame([(f"u{i}",) for i in range(30)], "url string")
    order = [r[0] for r in crawl.shuffled(urls, 3).collect()]
    assert sorted(order) == sorted(f"u{i}" for i in range(30)) and order == [r[0] for r in crawl.shuffled(urls.repartition(5), 3).collect()] != sorted(order)

    def page(start, n):
        if start == 40:
            raise ConnectionError("down")
        return [("arxiv", f"http://x/{i}") for i in range(start, start + n)]

    crawl.register(spark, page)
    got = {r["url"] for r in spark.read.format("millrace_paged").option("count", 65).option("batch", 20).load().collect()}
    assert got == {f"http://x/{i}" for i in range(65) if not 40 <= i < 60}  # a failing page ends its batch alone


def test_stores(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "raw" / "site").mkdir(parents=True)
    (tmp_path / "raw" / "site" / "a.raw").write_bytes(b"caf\xe9 ok")
    r = files.raw_files(spark, f"{root}/raw").first()
    assert r["source"] == "site" and r["text"] == "caf\ufffd ok"
    log = spark.createDataFrame([("u", 200, 5, 1.5, None)], files.CRAWL_LOG)
    files.append_log(log, f"{root}/log")
    files.append_log(log, f"{root}/log")
    assert spark.read.schema(files.CRAWL_LOG).json(f"{root}/log").count() == 2
    files.write_once(log, f"{root}/once")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_once(log, f"{root}/once")
    index = spark.createDataFrame([("h1", "s", "p", 5), ("h1", "s", "q", 5), (None, "s", "r", 1)], "hash string, source string, path string, chars long")
    index.write.json(f"{root}/index")
    assert rows(files.hash_index(spark, f"{root}/index")) == [("h1",)] and files.hash_index(spark, f"{root}/none").count() == 0
    windows = spark.range(100).selectExpr("id window_id", "array(cast(id as int)) tokens")
    files.write_windows(windows, f"{root}/windows")
    assert [r["window_id"] for r in files.read_windows(spark, f"{root}/windows", 10, 13).orderBy("window_id").collect()] == [10, 11, 12]
    calls = []
    compute = lambda: (calls.append(1), spark.range(3))[1]
    assert files.cached_diagrams(spark, f"{root}/d", "sha", compute).count() == files.cached_diagrams(spark, f"{root}/d", "sha", compute).count() == 3 and len(calls) == 1
    m = spark.createDataFrame([(1, 2.5, None)], "round_id int, ppl double, note string")
    assert files.promotion_log(m, ("round_id", "ppl")) == "| round_id | ppl |\n|---|---|\n| 1 | 2.5 |\n"
    with pytest.raises(Exception, match="note is null"):
        files.promotion_log(m, ("round_id", "note"))


def test_checkpoints_and_cache(spark, tmp_path):
    folder = str(tmp_path / "ck")
    (tmp_path / "ck").mkdir()
    with pytest.raises(FileNotFoundError):
        checkpoints.promote(spark, folder)
    with pytest.raises(FileNotFoundError):
        checkpoints.rollback(spark, folder)
    latest, champion = tmp_path / "ck" / "latest", tmp_path / "ck" / "champion"
    latest.write_text("one")
    checkpoints.promote(spark, folder)
    latest.write_text("two")
    assert champion.read_text() == "one"
    checkpoints.rollback(spark, folder)
    assert latest.read_text() == "one" and champion.read_text() == "one"
    latest.write_text("three")
    checkpoints.promote(spark, folder)
    assert champion.read_text() == "three" and not [f for f in os.listdir(folder) if f.endswith((".tmp", ".old"))]
    calls = []
    extract = lambda: (calls.append(1), spark.range(4))[1]
    got = [checkpoints.cached(spark, f"{folder}/t", name, extract) for name in ("a", "a", "b")]
    assert [(df.count(), known) for df, known in got] == [(4, False), (4, True), (4, False)] and len(calls) == 2


def test_round_budget_and_fresh_files(spark, tmp_path):
    raw, store = tmp_path / "raw" / "arxiv.org", str(tmp_path / "store")
    raw.mkdir(parents=True)
    (raw / "a.raw").write_text(" ".join(f"word{i}" for i in range(200)) + ".")
    query = ingest.ingest(ingest.raw_stream(spark, str(tmp_path / "raw")), store, str(tmp_path / "cp"))
    assert ingest.within(query, 300) is True and not query.isActive
    assert [r["source"] for r in spark.read.parquet(f"{store}/documents").collect()] == ["arxiv"]  # the domain's alias
    files_ = spark.createDataFrame([("a", 10), ("b", 20)], "path string, t long").select("path", F.timestamp_seconds("t").alias("modificationTime"))
    assert [r["path"] for r in ingest.fresh(files_, files_.where("path = 'b'").first()["modificationTime"]).collect()] == ["b"]
    text = spark.createDataFrame([("a",), ("b",), ("a",)], "hash string")
    assert ingest.unique_stream(text).count() == 2


def test_lookup_and_manifest(spark):
    topo = spark.createDataFrame([(1, 1, True, ["R1"], 5), (1, 1, False, [], 9)], "run_id int, round_id int, veto boolean, causes array<string>, ord int")
    asked = spark.createDataFrame([(1, 1), (1, 2)], "run_id int, round_id int")
    assert rows(gates.veto_lookup(asked, topo, "run_id", "round_id")) == [(1, 1, True, ["R1"]), (1, 2, False, [])]
    assert gates.treatment_manifest("lr_spike", b=1, a=2) == '{"a":2,"b":1,"kind":"lr_spike"}'
    docs = spark.createDataFrame([(0, "a b a b"), (1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in reports.round_diversity(docs, 3).collect()] == [(3, 0.5)]
    with pytest.raises(RuntimeError):
        gates.fail_closed(asked, topo.where("round_id = 1"), "run_id")


def test_token_counts_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The cat sat.", "", None, "élan 12 " * 50]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    want = [(i, len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids), len((t or "").split())) for i, t in enumerate(texts)]
    assert rows(reports.token_counts(docs, path)) == want
