from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language, pii
from millrace.llm.common import Scratch, with_keys, without_keys
from millrace.llm.html import main_text
from millrace.llm.language import identify
from millrace.llm.minhash import near_duplicates, one_of_each, shingles
from millrace.llm.quality import assess
from millrace.llm.sharding import shard_by_bytes


def frame(spark, rows, extra="clash"):
    return spark.createDataFrame([(i, t, extra, 1.0) for i, t in rows], "doc_id long, text string, digest string, score double")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


def groups(sets, percent=80):
    label = {i: i for i in sets}
    ids = list(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = words(rng, 80).split()
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 14)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "oNE"), (905, rows[0][1]), (906, "É"), (907, "é")]
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    want = groups(sets)
    for width in (2, 5):
        got = {r["doc_id"]: r for r in near_duplicates(frame(spark, [*rows, rows[3], (None, "lost words here")]), width).collect()}
        if width == 2:
            assert {i: got[i]["component_id"] for i in want} == want
            assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in want)
        assert got[None]["kept"] and got[900]["kept"] and got[904]["component_id"] == 903
    assert near_duplicates(frame(spark, [])).count() == 0


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = words(rng, 60).split()
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"y{rng.randint(0, 99999)}"
        rows.append((i, " ".join(text)))
    want = groups({i: set(shingles(t).tolist()) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_ranges_of_the_orders_change_nothing(spark):
    rng = random.Random(15)
    rows = []
    for g in range(40):  # templates: regions of many sizes, sparse and dense
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(rng.choice((2, 5, 40, 90))):
            text = list(base)
            for at in rng.sample(range(60), rng.randint(0, 9)):
                text[at] = f"u{len(rows)}x{at}"
            rows.append((len(rows), " ".join(text)))
    got = []
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got.append({r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] and sum(c != i for i, c in got[0].items()) > 100


def test_rows_that_repeat_an_id_or_have_none(spark):
    rng = random.Random(21)
    a, b, c = (words(rng, 50) for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (7, a), (9, b + " more"), (None, b), (None, c), (None, c + " x"), (4, None), (4, None), (3, "  ")]
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted([(5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (0, 5, False), (0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True), (3, 3, True)])
    kept = one_of_each(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept)) in [sorted([(0, x), (3, "  "), (4, ""), (4, ""), (5, a), (5, b)]) for x in (c, c + " x")]
    assert all(r["digest"] == "clash" for r in kept) and one_of_each(frame(spark, [])).count() == 0


def test_pairs_far_apart_among_thousands_of_documents_on_one_template(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    rows, kept, last = [], [], 7199
    for i in range(last + 1):
        text = list(base)
        for at in rng.sample(range(200), 5 if i in (60, last) else 9):
            text[at] = f"u{i}x{at}"
        rows.append((i, " ".join(text)))
        kept.append([text[j] == base[j] and text[j + 1] == base[j + 1] for j in range(199)])
    same = np.array(kept, np.float32)
    shared = same @ same.T  # own words are in no other document, and every document has 199 shingles
    a, b = np.nonzero(np.triu(100 * shared >= 80 * (398 - shared), 1))
    assert len(a) < 1000 and (60, last) in set(zip(a.tolist(), b.tolist(), strict=True))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    found = [got[x] == got[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got[60] == got[last] and sum(found) >= 0.98 * len(found)
    linked = set(a.tolist()) | set(b.tolist())
    assert all(c == i for i, c in got.items() if i not in linked)


def test_key_filters(spark):
    rows = spark.createDataFrame([(i, i % 3, str(i)) for i in range(200)], "a long, b long, text string")
    wanted = spark.range(0, 200, 7).selectExpr("id a", "id % 3 b", "'x' extra")
    assert {r["a"] for r in with_keys(rows, ["a", "b"], wanted).collect()} == set(range(0, 200, 7))
    assert {r["a"] for r in without_keys(rows, ["a", "b"], wanted).collect()} == set(range(200)) - set(range(0, 200, 7))
    assert without_keys(rows, ["a", "b"], wanted.limit(0)).count() == 200 and with_keys(rows, ["a", "b"], wanted.limit(0)).count() == 0


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(500)] + [(600, None), (601, "x " * 30000), (602, ""), (602, "")]
    out = shard_by_bytes(frame(spark, rows).repartition(7), 10).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    loads: dict = {}
    for r in out:
        loads.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in loads.values()) and set(loads) <= set(range(10))
    target, largest = sum(r["size"] for r in out) / 10, max(r["size"] for r in out)
    assert all(abs(sum(s for _, s in v) - target) <= largest for v in loads.values())
    assert shard_by_bytes(frame(spark, []), 10).count() == 0


def test_language(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the and with from that this which over under into house river".split(), "de": "der die und mit von dass nicht über unter haus fluss ich".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")
    docs = frame(spark, [(1, "the river with the house"), (2, "und nicht über die haus"), (3, None), (4, ""), (5, "12 34 !!"), (6, "漢字仮名" * 200)])
    got = {r["doc_id"]: r for r in identify(docs, train).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert not got[1]["rejected"] and got[3]["rejected"] and got[6]["rejected"] and got[1]["digest"] == "clash"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    many = train.unionByName(spark.range(5000).selectExpr("id doc_id", "'the river and the house with this' text", "'xx' lang")).where("lang <> 'en'")
    rare = many.unionByName(spark.createDataFrame([(7, "und der die haus " * 9, "yy")], "doc_id long, text string, lang string"))
    model = language.train(rare)
    assert model.languages == ["de", "xx", "yy"] and model.predict("the river and the house")[0] == "xx"
    again = language.train(rare.repartition(3))
    assert (again.matrix == model.matrix).all() and (again.idf == model.idf).all()
    long = identify(frame(spark, [(1, "the river with the house " * 60_000), (1, "the river with the house " * 60_000)]), train).collect()
    assert [r["lang_pred"] for r in long] == ["en", "en"]
    none = identify(docs, train.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and identify(docs.limit(0), train).count() == 0


def test_sampled_texts_are_bounded_and_of_least_hash(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 30)
    rows = spark.range(4000).selectExpr("concat('text ', cast(id % 700 as string)) text", "if(id % 7 = 0, 'a', 'b') lang")
    got = {}
    monkeypatch.setattr(language.Centroids, "fit", classmethod(lambda cls, counts, labels, df, n: got.update(labels=labels, n=n, df=df)))
    language.train(rows)
    assert got["n"] == 4000 and {x: got["labels"].count(x) for x in "ab"} == {"a": 30, "b": 30} and got["df"].max() == 4000


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, (words(rng, 60) + ". ") if i % 2 else " ".join("#$%" + str(rng.randint(0, 9)) + "&&" for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(1, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in assess(frame(spark, [*rows, (900, None), (901, ""), (902, "a" * 100000)]), labels).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(400)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in assess(frame(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}
    assert assess(frame(spark, []), labels).count() == 0


BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_formats():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@b", "1", "22", ".", "1.2.3.4", "+", "-", " ", "(", "4111111111111111", "é", "256", "a.b", "..", "+1 (523) 555-1055", "_", "%"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_context_finds_what_the_formats_miss(spark):
    seeds = [(i, f"please call phone +1 (523) 555-1{i:03d} now") for i in range(30)] + [(100 + i, f"mail user{i}@site.example at once") for i in range(30)]
    rows = [*seeds, (500, "call phone (523) 555-9999 today"), (501, "é part number 1234-5678 only"), (502, None), (503, ""), (504, "+1 (826) 555-4081 190.137.223.204")]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows)).collect()}
    assert [tuple(s) for s in got[500]["added"]] == [(11, 3, 25)] and got[501]["added"] == [] and got[502]["base"] == []
    assert all(sorted(tuple(s) for s in got[i]["base"]) == brute(t or "") for i, t in rows)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert masked[500] == "call phone [PHONE] today" and masked[100] == "mail [EMAIL] at once" and masked[502] is None
    assert masked[504] == "[PHONE] [IP]"
    assert pii.find(frame(spark, [])).count() == 0


def test_candidates_are_runs_of_tokens_outside_base_spans():
    def spans(text):
        return [(text[s:e], k) for s, k, e in sorted(pii.loose_spans(text, pii.base_spans(text)))]

    assert spans("in 1999 to 2004, no 030/1234 5678.") == [("030/1234 5678", 3)]
    assert spans("1.2.3.4, 4111111111111111, +1 (523) 555-1055") == [] and spans("") == spans("no digit") == []
    assert ("+1 (843) 555-7672", 3) in spans("x +1 (843) 555-7672 170.106.47.218 y") and ("170.106.47.218", 1) not in spans("x +1 (843) 555-7672 170.106.47.218 y")
    assert ("7536784127813050", 2) in spans("7536784127813050 4845168114407329")
    assert spans("bob at mail dot example dot org, or amy[at]mail.example") == [("bob at mail dot example dot org", 0), ("amy[at]mail.example", 0)]
    rng = random.Random(3)
    parts = ["1", "22", "333", ".", " ", " - ", "(", ")", "+", "4111111111111111", "a", "@b.c", "1.2.3.4", "/", "[.]"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base = pii.base_spans(text)
        for s, _, e in pii.loose_spans(text, base):
            assert 0 <= s < e <= len(text) and text[e - 1].isdigit() and all(e <= a or s >= b for a, _, b in base), text


def test_candidates_are_bounded_by_digits_alone():
    def found(text):
        return [text[s:e] for s, k, e in pii.loose_spans(text, pii.base_spans(text)) if k == 3]

    assert found("id 5 2 3 5 5 5 9 9 9 9 end") == ["5 2 3 5 5 5 9 9 9 9"]  # ten tokens
    apart = "555 " + "- " * 60 + "123 4567"
    assert found(f"call {apart} now") == [apart]  # over 80 characters
    assert max(sum(c.isdigit() for c in x) for x in found("1 2 3 " * 50)) <= 17
    for text in ("( " * 30_000 + "5", "5 - " * 30_000, "( 5 " * 30_000):  # in time that the length sets
        assert all(len(x) < 200 for x in found(text))


def test_context_words_are_whole():
    word = "x" * 100
    text = f"{word} 5551234567 {word}y"
    assert pii.contexts(text, 101, 111, 3)[:2] == [f"L {word}", f"R {word}y"]
    assert pii.contexts("near 12 " + "1 " * 40 + "5551234567", 88, 98, 3) == ["S dddddddddd"]  # no word within reach


def test_contexts_discover_forms_that_no_seed_has(spark):
    seeds = [(i, f"please call phone +1 (523) 555-1{i:03d} now") for i in range(30)]
    rows = [*seeds, (500, "they call phone 030/1234 5678 today"), (501, "call phone 19 - 28 / 37 - 46 often"), (502, "our part number 030/1234 5679 only"), (503, "call phone number 12 of them"), (504, "write to sales at shop dot example dot org")]
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find(frame(spark, rows)).collect()}
    assert got[500] == [(16, 3, 29)] and got[501] == [(11, 3, 28)] and got[502] == got[503] == got[504] == []


def test_scores_equal_a_plain_loop(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(900):
        kind, i = rng.randint(0, 3), rng.randint(0, 60)
        seed = i < 54
        patterns = {f"p{kind}{rng.randint(0, 3)}" if rng.random() < 0.98 else f"p{rng.randint(0, 3)}{rng.randint(0, 3)}" for _ in range(3)}
        rows.append((kind, f"{kind}-{i}", sorted(patterns), seed))
    edges, seeds = {(p, k, i) for k, i, ps, _ in rows for p in ps}, {(k, i): 1.0 for k, i, _, s in rows if s}
    sides: dict = {}
    for p, k, i in edges:
        sides.setdefault(p, set()).add((k, i))
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        trust = {(p, k): sum(scores.get(x, 0) for x in at if x[0] == k) / (sum(x[0] == k or x in seeds for x in at) + pii.PRIOR) for p, at in sides.items() for k in range(4)}
        found: dict = {}
        for p, k, i in edges:
            if trust[p, k] >= pii.TRUST and (k, i) not in seeds:
                found[k, i] = max(found.get((k, i), 0), trust[p, k])
        scores = seeds | found
    df = spark.createDataFrame(rows, "kind int, instance string, patterns array<string>, seed boolean")
    got = {(r["kind"], r["instance"]): r["score"] for r in pii._accepted(df, Scratch(spark, "test")).collect()}
    assert got.keys() == scores.keys() and all(abs(got[x] - scores[x]) < 1e-9 for x in got) and 0 < len(got) - len(seeds) < 64


def test_personal_data_of_rows_without_an_id(spark):
    seeds = [(i, f"please call phone +1 (523) 555-1{i:03d} now") for i in range(30)]
    rows = [*seeds, (None, "call phone (523) 555-9999 today"), (77, "call phone (523) 555-9999 today"), (77, "call phone (523) 555-8888 now"), (77, "call phone (523) 555-8888 now")]
    masked = sorted(r["text"] for r in pii.redact(frame(spark, rows)).collect())
    assert masked.count("call phone [PHONE] today") == 2 and masked.count("call phone [PHONE] now") == 2 and len(masked) == len(rows)
    numbers = pii.find(frame(spark, [(5, "12 34 5. " * 30_000), (6, "a@b.example.com")])).collect()
    assert {r["doc_id"]: len(r["base"]) for r in numbers} == {5: 0, 6: 1}  # more mentions than one row holds
    long = [(1, "x " * 400_000 + "mail a@b.example.com"), (1, "x " * 400_000 + "mail a@b.example.com")]
    assert [[tuple(s) for s in r["base"]] for r in pii.find(frame(spark, long)).collect()] == [[(800_005, 0, 800_020)]] * 2
    assert pii.redact(frame(spark, [])).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>One</li></ul></nav>
    <div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1><p>First   <b>paragraph</b>
    of text, long enough.<p>Second &eacute; one.<aside>Side</aside><form>Name <input></form><script>x("</p>")</script>
    <section class="comments"><p>Nice!</p></section></article><div class="sidebar">More</div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst paragraph of text, long enough.\nSecond é one."
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""
    assert main_text("<p>Only this</p>") == "Only this"
    soup = "<div><a>a</a><a>b</a><a>c</a></div>" + "".join(f"<div>{'A long line of running text about something. ' * 6}{i}</div>" for i in range(4)) + "<div><a>x</a></div>"
    assert main_text(soup).count("\n") >= 3 and "something. 3" in main_text(soup)


def test_pipeline_judges_rows_without_an_id_and_with_a_repeated_one(spark, tmp_path):
    rng = random.Random(19)
    clean = [(i, words(rng, 80) + ".", "en") for i in range(150)]
    bad = lambda: " ".join(rng.choice(("#$%&", "!!!", "&&&x")) for _ in range(80))
    rows = [*clean, (None, clean[0][1], "en"), (None, bad(), "en"), (7, bad(), "en"), (8, words(rng, 80) + ".", "en"), (9, clean[9][1], "en"), *[(600 + i, bad(), "en") for i in range(60)]]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i < 500), 0) for i, *_ in rows if i and (i < 140 or i >= 600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
    got = sorted((r["doc_id"], r["text"]) for r in at.collect())
    assert got == sorted([(i, t) for i, t, _ in [*clean, rows[153]]])


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    clean = [(i, words(rng, 80) + ".", "en") for i in range(150)]
    rows = [*clean, (500, clean[0][1], "en"), (501, None, "en"), (502, "### $$$ 11 22", None), (503, " ".join(["#$%&"] * 80), "en")] + [(600 + i, " ".join(rng.choice(("#$%&", "!!!", "&&&x")) for _ in range(80)), "en") for i in range(60)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _, _ in rows if i < 140 or i >= 600], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in at.collect()}
    assert ids == {i for i, _, _ in clean}
    assert at.where("doc_id = 3").first()["text"] == clean[3][1]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert packed.agg(F.min("length")).first()[0] > 0


def test_query_counts_each_kind(spark, tmp_path):
    texts = ["+1 (523) 555-1055", "1.2.3.4 and 5.6.7.8", "a@b.example.com, 4111 1111 1111 1111, c@d.example.com", "no data", None, ""]
    rows = [*enumerate(texts), (-(1 << 63), texts[0]), (None, texts[0]), (7, texts[2]), (7, texts[2])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:6] for r in pii.op10_pii(spark, str(tmp_path)).collect()]
    want = []
    for i, t in rows:
        base = brute(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_signs_without_digits_take_time_in_proportion():
    assert list(pii.loose_spans("1 " + "(" * 300_000, [])) == []
    assert [(s, k) for s, k, _ in pii.loose_spans("[" * 300_000 + " a 555 1234", [])] == [(300_003, 3)]
