"""Facts from token tables against one loop over each sentence."""

from __future__ import annotations

import random

from millrace.functions.text import DETERMINERS, PRONOUNS
from millrace.operators import parsed

SCHEMA = f"doc_id long, {parsed.TOKENS}, extra string"


def entity(sentence, token):
    """By a walk of the tree."""

    def below(t):
        return {t[1]} | {x for c in sentence if c[6] == t[1] and c[1] != t[1] for x in below(c)}

    words = [t[2] for t in sentence if t[1] in below(token) and t[4] not in ("PUNCT", "SPACE")] if token[5] in parsed.PHRASES else [token[2]]
    words = (" ".join(words) or token[2]).strip().lower().split()
    while words and words[0] in DETERMINERS:
        words = words[1:]
    lemma = (token[3] or "").lower().strip()
    return lemma if len(lemma) > 2 and lemma not in PRONOUNS else " ".join(words)


def said(sentence):
    """(sub, rel, obj, conf) of one sentence, read token by token."""
    kids = lambda t, *deps: [c for c in sentence if c[6] == t[1] and c[1] != t[1] and c[5] in deps]
    out = []
    for t in sentence:
        if t[4] == "VERB" and (t[1] == t[6] or t[5] == "conj"):
            if kids(t, "auxpass") and kids(t, "nsubjpass"):
                agents = [kids(a, "pobj")[0] for a in kids(t, "agent") if kids(a, "pobj")]
                if agents:
                    out.append((agents[-1], t[3].lower(), kids(t, "nsubjpass")[0], 0.65))
            elif kids(t, "nsubj") and kids(t, "dobj", "obj"):
                out.append((kids(t, "nsubj")[0], t[3].lower(), kids(t, "dobj", "obj")[0], 0.7))
        if t[3] == "be" and t[4] in ("AUX", "VERB") and kids(t, "nsubj") and kids(t, "attr"):
            out.append((kids(t, "nsubj")[0], "is_a", kids(t, "attr")[0], 0.9))
        if t[5] == "appos":
            out += [(h, "is_a", t, 0.6) for h in sentence if h[1] == t[6] and h[5] in parsed.EXPLAINED]
    facts = [(entity(sentence, a), rel, entity(sentence, b), conf) for a, rel, b, conf in out]
    ok = lambda e: 2 <= len(e) <= 60 and e not in PRONOUNS and any(c.isalnum() for c in e)
    return [f for f in facts if ok(f[0]) and ok(f[2])]


def sentences(n):
    """Random trees with the rules' dependencies."""
    rng = random.Random(12)
    out = []
    for s in range(n):
        size = rng.randint(1, 9)
        order = list(range(1, size + 1))
        rng.shuffle(order)
        head = {order[0]: order[0]} | {x: rng.choice(order[:k]) for k, x in enumerate(order) if k}
        rows = []
        for i in range(1, size + 1):
            lemma = rng.choice(("be", "cat", "ox", "it", "someone", "Robin", "", "see", "find", "a"))
            pos = rng.choice(("VERB", "VERB", "NOUN", "AUX", "PUNCT")) if head[i] != i else rng.choice(("VERB", "AUX"))
            dep = "ROOT" if head[i] == i else rng.choice(("nsubj", "nsubj", "dobj", "obj", "attr", "appos", "pobj", "agent", "auxpass", "nsubjpass", "conj", "det"))
            rows.append((s, i, rng.choice(("The", "cats", "Ox", "It", "--", "an", "of", "x1")), lemma, pos, dep, head[i]))
        out.append(rows)
    for s in range(n, n + 3):  # the passive, with one agent, two agents and none
        rows = [(s, 1, "Mice", "mouse", "NOUN", "nsubjpass", 3), (s, 2, "were", "be", "AUX", "auxpass", 3), (s, 3, "chased", "Chase", "VERB", "ROOT", 3)]
        out.append(rows + [t for k in range(n + 2 - s) for t in ((s, 4 + 2 * k, "by", "by", "ADP", "agent", 3), (s, 5 + 2 * k, f"cat{k}", f"cat{k}", "NOUN", "pobj", 4 + 2 * k))])
    return out


def test_rules_equal_a_loop(spark):
    trees = sentences(1500)
    rows = [(s[0][0] // 7, *t, "clash") for s in trees for t in s]
    rows += rows[:20] + [(None, 0, 1, "Lost", "lost", "NOUN", "nsubj", 9, ""), (9999, 0, 1, None, None, None, None, None, "")]
    got = parsed.dependency_facts(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.0).collect()
    want = [(s[0][0] // 7, *f) for s in trees for f in said(s)]
    assert sorted(map(tuple, got)) == sorted(want) and {f[4] for f in want} == {0.7, 0.65, 0.9, 0.6}
    sure = parsed.dependency_facts(spark.createDataFrame(rows, SCHEMA), 0.7).collect()
    assert {r["conf"] for r in sure} == {0.7, 0.9}


def test_long_sentences_by_joins(spark):
    """What a sentence's length decides is the way only; and gathered once, sentences are neither shuffled nor joined again."""
    trees = sentences(300)
    rows = [(s[0][0] // 7, *t, "") for s in trees for t in s]
    tokens = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(tuple, parsed.dependency_facts(tokens, 0.0, places=True, long=n).collect())) for n in (0, 4, 256)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20
    plan = parsed.dependency_facts(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_heads_in_a_circle(spark):
    rows = [(1, 0, 1, "Ox", "ox", "NOUN", "nsubj", 2), (1, 0, 2, "sees", "see", "VERB", "ROOT", 2), (1, 0, 3, "Ax", "ax", "NOUN", "dobj", 2)]
    rows += [(1, 0, 4, "x", "x", "NOUN", "det", 5), (1, 0, 5, "y", "y", "NOUN", "det", 4), (2, 0, 1, "Ox", "ox", "NOUN", "nsubj", 2), (2, 0, 2, "a", "see", "VERB", "conj", 1), (2, 0, 3, "Ax", "ax", "NOUN", "dobj", 2)]
    got = parsed.dependency_facts(spark.createDataFrame(rows, f"doc_id long, {parsed.TOKENS}")).collect()
    assert sorted((r["doc_id"], r["sub"], r["obj"]) for r in got) == [(1, "ox", "ax"), (2, "ox a ax", "ax")]


def test_tokens_as_in_sql(spark, tmp_path):
    """Spark's own form of the token table has the rows of the SQL, keys without a kind included."""
    from millrace.plans import derived

    spark.sql("SELECT id - 3 AS l_orderkey, id * 5 AS l_partkey, id * 7 AS l_suppkey, CAST(id % 3 AS INT) AS l_linenumber FROM range(40) UNION ALL SELECT NULL, 1, 1, 1").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    want, got = spark.sql(derived.sql_of("tokens")), derived.table(spark, str(tmp_path), "tokens")
    assert got.schema.simpleString() == want.schema.simpleString() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_parse_adapter(spark):
    def parser():
        """Splits at full stops; the second word is the root verb, the first its subject, the last its object."""

        def tokens(text):
            for s, sentence in enumerate(filter(None, text.split("."))):
                words = sentence.split()
                for i, w in enumerate(words):
                    dep = {0: "nsubj", 1: "ROOT", len(words) - 1: "dobj"}.get(i, "det")
                    yield s, i, w, w.lower(), "VERB" if i == 1 else "NOUN", dep, 1

        return tokens

    docs = spark.createDataFrame([(1, "Cats chase the mice. Dogs find balls.", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, sent string")
    tokens = parsed.parse(docs, parser, batch=3)
    assert tokens.count() == 7
    got = parsed.dependency_facts(tokens, places=True).orderBy("sent").collect()
    assert [(r["sub"], r["rel"], r["obj"]) for r in got] == [("cats", "chase", "mice"), ("dogs", "find", "balls")]


def test_empty_table(spark):
    assert parsed.dependency_facts(spark.createDataFrame([], SCHEMA)).count() == 0
