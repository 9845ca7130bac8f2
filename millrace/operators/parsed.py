"""Facts from a token table: rules over dependencies, sentence by sentence, or as joins on head indices where one is very long."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import FACTS
from millrace.functions import text as T
from millrace.lineage import cut
from millrace.ship import ship

#: A token: sentence and place in it, its text and lemma, its part of speech and dependency as Universal Dependencies' English models name them, the place of its head (its own for the root).
TOKENS = "sent int, i int, text string, lemma string, pos string, dep string, head int"
# Dependencies of arguments that stand for their whole phrase, and those that an apposition may explain.
PHRASES = ("nsubj", "nsubjpass", "dobj", "attr", "appos", "pobj")
EXPLAINED = ("nsubj", "nsubjpass", "dobj", "pobj", "attr")
#: Confidence of the rules, in the order in which a sentence is read.
RULES = {"active": 0.7, "passive": 0.65, "copula": 0.9, "apposition": 0.6}

#: Tokens up to which a sentence is read by itself.
LONG = 256

Parser = Callable[[str], Iterable[tuple[int, int, str, str, str, str, int]]]


def parse(docs: DataFrame, make: Callable[[], Parser], key: str = "doc_id", batch: int = 10_000) -> DataFrame:
    """``key`` and the :data:`TOKENS` of every text, by a parser that each task makes for itself.

    ``make`` must be picklable; the parser yields rows as :data:`TOKENS` has them. Rows are handed on in parts of ``batch``, so a long
    text does not fill a worker. A null text has no tokens.
    """
    ship(docs.sparkSession)
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, ids, found, schema = make(), [], [], None

        def made() -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            columns = [pa.array([row[k] for row in found], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([pa.array(ids, schema), *columns], [key, *names])

        for b in batches:
            schema = b.schema.field(0).type
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in parser(text) if text is not None else ():
                    ids.append(id_)
                    found.append(row)
                    if len(found) == batch:
                        yield made()
                        ids, found = [], []
        if found:
            yield made()

    return rows.mapInArrow(tokens, f"{key} {kind.simpleString()}, {TOKENS}")


def _among(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _first(dep: tuple[str, ...]) -> Column:
    """The first child with one of these dependencies."""
    return F.min(F.when(_among("dep", *dep), F.col("i")))


def _phrases(tokens: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``key, sent, i, phrase`` of the wanted tokens: the texts of all tokens below them, in their order, without punctuation.

    One round per level of the trees below, over the wanted tokens alone.
    """
    at = [key, "sent"]
    edge = tokens.where("i <> head").select(*at, F.col("head").alias("_from"), F.col("i").alias("_to"))
    below = [cut(wanted.select(*at, "i", F.col("i").alias("_to")))]
    while below[-1].limit(1).count():
        below.append(cut(below[-1].withColumnRenamed("_to", "_from").join(edge, [*at, "_from"]).select(*at, "i", "_to")))
    members = reduce(DataFrame.union, below).distinct()
    words = tokens.where(~_among("pos", "PUNCT", "SPACE")).select(*at, F.col("i").alias("_to"), "text")
    inside = members.join(words, [*at, "_to"]).groupBy(*at, "i").agg(F.array_sort(F.collect_list(F.struct("_to", "text"))).alias("_w"))
    return inside.select(*at, "i", F.array_join("_w.text", " ").alias("phrase"))


def _rules_by_joins(tokens: DataFrame, min_conf: float, key: str) -> DataFrame:
    """The facts of distinct tokens with ``sent, part, pos``, by joins: for sentences too long to be read by themselves.

    What each head has below it is one aggregation over (document, sentence, head), and the rules are joins with it: equi-joins on keys that
    no document shares, so no hot group. Phrases are put together level by level.
    """
    at = [key, "sent"]
    children = tokens.where("i <> head")
    below = children.groupBy(*at, F.col("head").alias("i")).agg(
        F.max(_among("dep", "auxpass")).alias("auxpass"),
        _first(("nsubj",)).alias("subject"),
        _first(("nsubjpass",)).alias("done_to"),
        _first(("dobj", "obj")).alias("object"),
        _first(("attr",)).alias("attribute"),
        _first(("pobj",)).alias("of"),
    )
    agents = children.where(_among("dep", "agent")).select(*at, "i", F.col("head").alias("_verb")).join(below.where("of is not null").select(*at, "i", "of"), [*at, "i"])
    agent = agents.groupBy(*at, F.col("_verb").alias("i")).agg(F.max_by("of", "i").alias("agent"))
    headed = tokens.join(below, [*at, "i"])
    root, verb = F.col("i") == F.col("head"), _among("pos", "VERB")
    verbs = headed.where(verb & (root | _among("dep", "conj"))).join(agent, [*at, "i"], "left")
    passive = F.col("auxpass") & F.col("done_to").isNotNull()
    # a sentence is read verb by verb, the root first, then its forms of be, then its appositions
    order = F.when(root, -1).otherwise(F.col("i"))
    said = [
        verbs.where(~passive & F.col("subject").isNotNull() & F.col("object").isNotNull()).select(*at, F.lit(0).alias("part"), order.alias("pos"), F.col("subject").alias("a"), F.col("object").alias("b"), F.lower("lemma").alias("rel"), F.lit(RULES["active"]).alias("conf")),
        verbs.where(passive & F.col("agent").isNotNull()).select(*at, F.lit(0).alias("part"), order.alias("pos"), F.col("agent").alias("a"), F.col("done_to").alias("b"), F.lower("lemma").alias("rel"), F.lit(RULES["passive"]).alias("conf")),
        headed.where((F.col("lemma") == "be") & _among("pos", "AUX", "VERB") & F.col("subject").isNotNull() & F.col("attribute").isNotNull()).select(
            *at, F.lit(1).alias("part"), F.col("i").alias("pos"), F.col("subject").alias("a"), F.col("attribute").alias("b"), F.lit("is_a").alias("rel"), F.lit(RULES["copula"]).alias("conf")
        ),
        children.where(_among("dep", "appos"))
        .join(tokens.where(_among("dep", *EXPLAINED)).select(*at, F.col("i").alias("head")), [*at, "head"])
        .select(*at, F.lit(2).alias("part"), F.col("i").alias("pos"), F.col("head").alias("a"), F.col("i").alias("b"), F.lit("is_a").alias("rel"), F.lit(RULES["apposition"]).alias("conf")),
    ]
    found = cut(reduce(DataFrame.union, said).where(F.col("conf") >= min_conf))
    asked = found.select(*at, F.explode(F.array("a", "b")).alias("i")).distinct()
    heads = cut(asked.join(tokens, [*at, "i"]).select(*at, "i", "text", "dep", "lemma"))
    low = F.lower(F.trim(F.coalesce("lemma", F.lit(""))))
    by_lemma = (F.length(low) > 2) & ~low.isin(*T.PRONOUNS)
    phrases = _phrases(tokens, heads.where(~by_lemma & _among("dep", *PHRASES)).select(*at, "i"), key)
    entity = T.normalize_entity(F.coalesce(F.when(F.col("phrase") != "", F.col("phrase")), F.col("text")), F.coalesce("lemma", F.lit("")))
    entities = cut(heads.join(phrases, [*at, "i"], "left").select(*at, "i", entity.alias("entity")))
    side = lambda name, of: entities.select(*at, F.col("i").alias(name), F.col("entity").alias(of))
    out = found.join(side("a", "sub"), [*at, "a"]).join(side("b", "obj"), [*at, "b"])
    return out.select(key, "sub", "rel", "obj", "conf", "sent", "part", "pos")


def _phrase(t: Column, i: Column) -> Column:
    """The texts of all tokens below place ``i`` of a sentence and at it, in their order, without punctuation; a circle of heads is walked once."""
    start = F.struct(F.array(i).alias("found"), F.array(i).alias("last"))

    def down(s: Column) -> Column:
        more = F.transform(F.filter(t, lambda c: F.array_contains(s["last"], c["head"]) & (c["i"] != c["head"]) & ~F.array_contains(s["found"], c["i"])), lambda c: c["i"])
        return F.get(F.transform(F.array(more), lambda m: F.struct(F.concat(s["found"], m).alias("found"), m.alias("last"))), 0)

    def words(found: Column) -> Column:
        inside = F.filter(t, lambda c: F.array_contains(found, c["i"]) & ~F.coalesce(c["pos"].isin("PUNCT", "SPACE"), F.lit(False)))
        return F.array_join(F.transform(F.array_sort(F.transform(inside, lambda c: F.struct(c["i"].alias("i"), c["text"].alias("text")))), lambda c: c["text"]), " ")

    level = F.aggregate(F.sequence(F.lit(1), F.size(t)), start, lambda s, _: F.when(F.size(s["last"]) == 0, s).otherwise(down(s)))
    return F.get(F.transform(F.array(level["found"]), words), 0)


def _said(t: Column) -> Column:
    """``part, pos, a, b, rel, conf`` of the facts of one sentence's tokens, as :func:`_rules_by_joins` finds them."""
    has = lambda c, *deps: F.coalesce(c["dep"].isin(*deps), F.lit(False))
    below = lambda h: F.filter(t, lambda c: (c["head"] == h["i"]) & (c["i"] != c["head"]))
    first = lambda kids, *deps: F.array_min(F.transform(kids, lambda c: F.when(has(c, *deps), c["i"])))
    verb = lambda v: F.coalesce(v["pos"] == "VERB", F.lit(False)) & (F.coalesce(v["i"] == v["head"], F.lit(False)) | has(v, "conj"))
    be = lambda v: F.coalesce((v["lemma"] == "be") & v["pos"].isin("AUX", "VERB"), F.lit(False))

    def fact(part: int, pos: Column, a: Column, b: Column, rel: Column, rule: str) -> Column:
        return F.struct(F.lit(part).alias("part"), pos.alias("pos"), a.alias("a"), b.alias("b"), rel.alias("rel"), F.lit(RULES[rule]).alias("conf"))

    def of_head(v: Column, kids: Column) -> Column:
        order = F.when(v["i"] == v["head"], -1).otherwise(v["i"])
        args = F.struct(first(kids, "nsubj").alias("subject"), first(kids, "nsubjpass").alias("done_to"), first(kids, "dobj", "obj").alias("object"), first(kids, "attr").alias("attribute"))
        agents = F.filter(F.transform(F.filter(kids, lambda g: has(g, "agent")), lambda g: F.struct(g["i"].alias("i"), first(below(g), "pobj").alias("of"))), lambda g: g["of"].isNotNull())
        passive = F.exists(kids, lambda c: has(c, "auxpass"))

        def spoken(x: Column) -> Column:
            active = F.when(x["subject"].isNotNull() & x["object"].isNotNull(), fact(0, order, x["subject"], x["object"], F.lower(v["lemma"]), "active"))
            suffered = F.get(F.transform(F.array(F.array_max(agents)["of"]), lambda a: F.when(a.isNotNull(), fact(0, order, a, x["done_to"], F.lower(v["lemma"]), "passive"))), 0)
            is_a = F.when(be(v) & x["subject"].isNotNull() & x["attribute"].isNotNull(), fact(1, v["i"], x["subject"], x["attribute"], F.lit("is_a"), "copula"))
            return F.array(F.when(verb(v), F.when(passive & x["done_to"].isNotNull(), suffered).otherwise(active)), is_a)

        return F.get(F.transform(F.array(args), spoken), 0)

    heads = F.flatten(F.transform(F.filter(t, lambda v: verb(v) | be(v)), lambda v: F.get(F.transform(F.array(below(v)), lambda kids: of_head(v, kids)), 0)))
    explained = lambda c: F.transform(F.filter(t, lambda p: (p["i"] == c["head"]) & has(p, *EXPLAINED)), lambda p: fact(2, c["i"], c["head"], c["i"], F.lit("is_a"), "apposition"))
    appositions = F.flatten(F.transform(F.filter(t, lambda c: has(c, "appos") & (c["i"] != c["head"])), explained))
    return F.filter(F.concat(heads, appositions), lambda f: f.isNotNull())


def _facts_of_sentences(sentences: DataFrame, min_conf: float, key: str) -> DataFrame:
    """The facts of ``key, sent, t``, each sentence by itself: rows neither move nor meet. Filters stay above generators, so that nothing is worked out twice."""
    at, t, f = [key, "sent"], F.col("t"), F.col("f")
    found = sentences.select(*at, "t", F.explode_outer(_said(t)).alias("f")).where(f["conf"] >= min_conf)

    def entity(x: Column) -> Column:
        whole = F.get(F.filter(F.array(_phrase(t, x["i"])), lambda p: p != ""), 0)
        return T.normalize_entity(F.coalesce(F.when(F.coalesce(x["dep"].isin(*PHRASES), F.lit(False)), whole), x["text"]), F.coalesce(x["lemma"], F.lit("")))

    named = lambda i: F.transform(F.filter(t, lambda x: x["i"] == i), entity)
    pairs = F.flatten(F.transform(named(f["a"]), lambda a: F.transform(named(f["b"]), lambda b: F.struct(a.alias("sub"), b.alias("obj")))))
    out = found.select(*at, "f", F.explode_outer(pairs).alias("e"))
    return out.select(key, "e.sub", "f.rel", "e.obj", "f.conf", "sent", "f.part", "f.pos")


def _valid(facts: DataFrame) -> DataFrame:
    return facts.where(T.is_valid_entity(F.col("sub")) & T.is_valid_entity(F.col("obj")) & F.col("rel").isNotNull())


def dependency_facts(tokens: DataFrame, min_conf: float = FACTS.min_conf, key: str = "doc_id", places: bool = False, long: int = LONG) -> DataFrame:
    """``key, sub, rel, obj, conf`` from ``tokens(key, …TOKENS)`` by four rules over dependencies.

    A root or conjoined verb with a subject and an object gives ``(subject, lemma, object)``; one in the passive,
    its agent as subject and what it is done to as object, never the other way, and nothing without an agent. A form of *be* with subject and attribute, and an
    apposition to an argument, give ``is_a``. Of several children the first counts, of several agents the last.

    Tokens are gathered by sentence, once, and written; a sentence of at most ``long`` tokens is read by itself, without another shuffle. One that is longer,
    in which looking for every head's children would cost the square of its tokens, is taken apart again for joins on head indices.
    An entity is its head's lemma, if that has over two letters; only for the others phrases are put together.
    A token whose head is missing has none; null dependencies or lemmas fit no rule; repeated rows give repeated facts once; an empty table gives none.
    ``places`` adds sentence, rule and token, ``sent, part, pos``, the order in which a sentence is read.
    """
    at = [key, "sent"]
    token = F.struct("i", "text", "lemma", "pos", "dep", "head")
    gathered = tokens.where(F.col(key).isNotNull() & F.col("sent").isNotNull()).groupBy(*at).agg(F.collect_set(token).alias("t"))
    sentences = cut(gathered.select(*at, F.size("t").alias("n"), "t"))
    out = _valid(_facts_of_sentences(sentences.where(F.col("n") <= long), min_conf, key))
    longer = sentences.where(F.col("n") > long)
    if longer.select("n").limit(1).count():
        out = out.unionByName(_valid(_rules_by_joins(cut(longer.select(*at, F.explode("t").alias("x")).select(*at, "x.*")), min_conf, key)))
    return out if places else out.drop("sent", "part", "pos")
