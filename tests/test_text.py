from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import minhash as M
from millrace.functions import quality as Q
from millrace.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_normalize_collapses_and_drops_blank_lines(spark):
    assert one(spark, " a\t b \n\n  \nc  d", T.normalize) == "a b\nc d"
    assert one(spark, "é", T.normalize) == "é"
    assert one(spark, "", T.normalize) == ""


def test_unwrap_joins_until_a_closer(spark):
    assert one(spark, "one\ntwo.\nthree:\nfour", T.unwrap) == "one two.\nthree:\nfour"


def test_chunks_pack_greedily_and_keep_long_lines(spark):
    assert one(spark, "aaaa\nbbbb\ncc\n" + "d" * 20, lambda c: T.chunks(c, 10)) == ["aaaa\nbbbb", "cc", "d" * 20]
    assert one(spark, "", lambda c: T.chunks(c, 10)) == []
    assert one(spark, None, lambda c: T.chunks(c, 10)) == []


def test_challenge_and_boilerplate(spark):
    assert one(spark, "<p>Checking your browser</p>", T.is_challenge) is True
    assert one(spark, "plain", T.strip_boilerplate) == "plain"
    assert one(spark, "x\n*** START OF THIS PROJECT Y ***\nbody\n*** END OF THIS PROJECT Y ***\nz", T.strip_boilerplate).strip() == "body"


def test_extract_main(spark):
    html = "<html><head><title>t</title></head><nav>menu</nav><p>one &amp; two</p><script>x()</script><p>three</p></html>"
    assert one(spark, html, T.extract_main) == "one & two\nthree"
    assert one(spark, "<p>captcha</p>", T.extract_main) is None
    assert one(spark, "<p> </p>", T.extract_main) is None


def test_entities(spark):
    assert one(spark, " The a Red Bird ", T.normalize_entity) == "red bird"
    assert one(spark, "it", T.is_valid_entity) is False
    assert one(spark, "--", T.is_valid_entity) is False


def test_url(spark):
    assert one(spark, "http://a.b:80/x", T.url_domain) == "a.b_80"
    assert len(one(spark, "http://a.b/x", T.url_key)) == 12


def test_quality_features(spark):
    assert one(spark, "One.\n\nTwo\n", Q.punct_line_frac) == 0.5
    assert one(spark, "", Q.punct_line_frac) == 0.0
    assert one(spark, "", Q.mean_word_len) == 0.0
    assert one(spark, "ab#!", Q.symbol_ratio) == 0.5
    assert one(spark, "The cat and the dog", Q.stopword_ratio) == 0.6


def test_violations_and_score(spark):
    clean = "This is a sentence that was written by the people of the town.\n" * 5
    f = spark.createDataFrame([(clean,), ("#### %%%% zzz\n" * 5,)], "x string").select(Q.mean_word_len(F.col("x")).alias("a"), Q.symbol_ratio(F.col("x")).alias("b"), Q.punct_line_frac(F.col("x")).alias("c"), Q.stopword_ratio(F.col("x")).alias("d"))
    v = [r["v"] for r in f.select(Q.violations(*map(F.col, "abcd")).alias("v")).collect()]
    assert v[0] == [] and v[1] == ["symbol_ratio", "punct_lines", "stopword_ratio"]
    s = [r["s"] for r in f.select(Q.quality_score(*map(F.col, "abcd")).alias("s")).collect()]
    assert s[0] > 0.8 > s[1]


def test_shingles_stay_within_lines(spark):
    assert one(spark, "A b c\nd e", lambda c: M.paragraph_shingles(c, 2)) == ["a b", "b c", "d e"]
    assert one(spark, "a", lambda c: M.paragraph_shingles(c, 2)) == []


def test_signature_matches_md5(spark):
    import hashlib

    sig = one(spark, ["x y", "y z"], lambda c: M.signature(c, 3), "array<string>")
    assert sig == [min(int(hashlib.md5(f"{s}:{g}".encode()).hexdigest()[:8], 16) for g in ("x y", "y z")) for s in range(3)]


def test_lines_and_white_space_of_any_kind(spark):
    assert one(spark, "One.\r\nTwo.\t\r\n \u00a0\x0b\x1c three!\u2028", Q.punct_line_frac) == 1.0
    assert one(spark, "a\u00a0\u3000b\r\nc\x0bd\x85e", T.normalize) == "a b\nc\nd\ne"
    assert one(spark, "\u2003x y\u00a0\x1f", T.strip) == "x y"


def test_repair():
    cases = {
        "cafÃ© dÃ©jÃ\u00a0 vu": "café déjà vu", "â€œquotedâ€\u009d itâ€™s": '"quoted" it\'s', "é\u00a0» fin": "é\u00a0» fin", "NÃO São": "NÃO São", "a &amp; b": "a & b", "<p>a &amp; b</p>": "<p>a &amp; b</p>",
        "ﬁne ＡＢ": "fine AB", "\x1b[31mred\x1b[0m\x00": "red", "Ã\u0083Â©": "é", "e\u0301": "é", "plain": "plain", "": "",
    }
    assert {x: T.repair(x) for x in cases} == cases


def test_extractors_can_be_replaced(spark):
    page = "<div><p>body</p></div>"
    fails = T.guarded(lambda p: 1 / 0)
    assert one(spark, page, lambda c: T.extract_main(c, fails, T.pattern_text)) == "body"
    assert one(spark, page, lambda c: T.extract_main(c, T.guarded(lambda p: " mine "), fails)) == "mine"
    assert one(spark, page, lambda c: T.extract_main(c, T.guarded(lambda p: "  "), fails)) is None
    assert one(spark, "<nav>only this</nav>", lambda c: T.extract_main(c, T.pattern_text, T.tag_free_text)) == "only this"
    assert one(spark, "captcha", lambda c: T.extract_main(c, T.guarded(lambda p: "x"))) is None


def test_lines_that_end_in_a_closer_equal_a_loop(spark):
    import random

    from millrace.functions import quality

    rng = random.Random(1)
    parts = ["a", "b.", "!", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "　", "”", "]", ")", "'", '"', "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]

    def plain(text):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        return sum(x[-1] in quality.LINE_CLOSERS for x in lines) / len(lines) if lines else 0.0

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", quality.punct_line_frac(df["t"]).alias("share")).collect():
        assert r["share"] == plain(r["t"]), r["t"]


def test_remixed_hashes_equal_those_of_the_engine(spark):
    from pyspark.sql import functions as F

    from millrace.functions import minhash as M

    rows = [(0, [f"w{i}" for i in range(700)]), (1, ["one"]), (2, []), (3, None), (4, ["é", "x y", ""])]
    frame = spark.createDataFrame(rows, "id long, g array<string>").repartition(2)
    plain = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda s: F.array_min(F.transform("g", lambda x: F.xxhash64(F.xxhash64(x), s))))
    want = {r["id"]: r["b"] for r in frame.select("id", F.when(F.size("g") > 0, plain).alias("b")).collect() if r["b"]}
    assert {r["id"]: r["sig"] for r in M.fast_signatures(frame, "id", F.col("g"), 128).collect()} == want and want.keys() == {0, 1, 4}
