"""Triplets, contradictions, quarantine and claim checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import FACTS, FactConfig
from millrace.functions import text as T
from millrace.functions.numbers import rounded
from millrace.functions.order import with_rank
from millrace.lineage import cut, drop

# Surface verbs that stand for a relation in an export.
ALIASES = {
    "is_a": ("is", "are", "was", "were"),
    "write": ("wrote",),
    "invent": ("invented",),
    "discover": ("discovered",),
    "locate": ("located",),
    "die": ("died",),
    "live": ("lived",),
    "found": ("founded",),
    "bear": ("born",),
    "have": ("has", "had"),
}
#: Triplets of a part of an export: bounds what a task holds.
PART_ROWS = 250_000
#: Before a word, of whatever alphabet; Java and RE2 read it alike, which they do not with a word boundary.
START = r"(?:^|[^\p{L}\p{N}_])"
#: Pattern families without a parser: regular expression and confidence. Two groups are subject and class; of three the second is the verb, and a passive's object comes first.
PATTERNS = (
    ("copula", START + r"([A-Za-z]+) (?:is|are|was|were) (?:a|an|the) ([A-Za-z]+)", 0.9),
    ("apposition", START + r"([A-Z][A-Za-z]+), (?:a|an|the) ([A-Za-z]+),", 0.6),
    ("passive", START + r"([A-Za-z]+) (?:is|are|was|were) ([a-z]+ed) by ([A-Za-z]+)", 0.65),
    ("active", START + r"([A-Za-z]+) ([a-z]+(?:ed|s)) (?:a|an|the) ([A-Za-z]+)", 0.7),
)
#: Words that end like verbs of the active pattern but are none.
NO_VERBS = ("as", "does", "has", "his", "hers", "is", "its", "ours", "plus", "these", "this", "those", "thus", "towards", "us", "was", "whereas", "yes", "yours")
#: Endings of regular verbs and what a lemma has instead, the first that fits; expressions that Java and RE2 read alike.
ENDINGS = (("ie[ds]$", "y"), ("(bb|dd|gg|mm|nn|pp|rr|tt)ed$", None), ("(ch|sh|ss|x|z)es$", "\\1"), ("ed$", ""), ("([^s])s$", "\\1"))


def lemma(verb: Column) -> Column:
    """A relation's name for a surface verb: of a listed alias its relation, else without a regular ending."""
    known = F.create_map(*[F.lit(x) for rel, names in ALIASES.items() if rel != "is_a" for n in names for x in (n, rel)])
    out = verb
    for pattern, instead in reversed(ENDINGS):
        cut_off = F.regexp_replace(verb, pattern, instead.replace("\\1", "$1")) if instead is not None else F.left(verb, F.length(verb) - 3)
        out = F.when(verb.rlike(pattern), cut_off).otherwise(out)
    return F.coalesce(F.try_element_at(known, verb), out)


def extract(docs: DataFrame, min_conf: float = FACTS.min_conf, key: str = "doc_id", places: bool = False) -> DataFrame:
    """``key, sub, rel, obj, conf`` by regular expressions: copula, apposition, agent and active phrases; lower recall than a parser.

    The documents are read once: each pattern goes over a text once, and groups are taken from its short matches. Where a
    parser is at hand, :func:`parse` and :func:`dependency_facts` give the same columns.
    ``places`` adds the pattern's number and the match's place, ``part, pos``.
    """
    used = [(k, *p) for k, p in enumerate(PATTERNS) if p[2] >= min_conf]
    matches = lambda k, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(k).alias("part"), i.alias("pos"), m.alias("m")))
    # the filter stays above the generator, so that matches are not looked for once more to count them
    every = docs.select(key, F.concat(*[matches(k, pattern) for k, _, pattern, _ in used]).alias("_all")).select(key, F.explode_outer("_all").alias("_m")).where("_m is not null")
    verbal = F.col("_m.part").isin(*[k for k, name, _, _ in used if name in ("passive", "active")])
    passive = F.col("_m.part").isin(*[k for k, name, _, _ in used if name == "passive"])

    def group(i: int) -> Column:
        of = [(k, F.regexp_extract("_m.m", pattern, i)) for k, name, pattern, _ in used if i < 3 or name in ("passive", "active")]
        return reduce(lambda out, x: F.when(F.col("_m.part") == x[0], x[1]).otherwise(out), of, F.lit(None).cast("string"))

    z = every.select(key, "_m", *[group(i).alias(f"g{i - 1}") for i in (1, 2, 3)])
    active = [k for k, name, _, _ in used if name == "active"]
    z = z.where(~(F.col("_m.part").isin(*active) & F.lower("g1").isin(*NO_VERBS))) if active else z
    sub, obj = F.when(passive, F.col("g2")).otherwise(F.col("g0")), F.when(passive, F.col("g0")).when(verbal, F.col("g2")).otherwise(F.col("g1"))
    conf = reduce(lambda out, x: F.when(F.col("_m.part") == x[0], F.lit(x[3])).otherwise(out), used, F.lit(None).cast("double"))
    rel = F.when(verbal, lemma(F.lower("g1"))).otherwise(F.lit("is_a"))
    out = z.select(key, T.normalize_entity(sub).alias("sub"), rel.alias("rel"), T.normalize_entity(obj).alias("obj"), conf.alias("conf"), F.col("_m.part").alias("part"), F.col("_m.pos").alias("pos"))
    out = out.where(T.is_valid_entity(F.col("sub")) & T.is_valid_entity(F.col("obj")))
    return out if places else out.drop("part", "pos")


def corpus_facts(docs: DataFrame, holdout: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """Triplets of all documents but exact copies of held-out ones, in no order: ``source_doc_hash, sub, rel, obj, conf, part, pos, triplet_id``; the id names hash, pattern and place, so it is the same in every run."""
    hashed = docs.withColumn("source_doc_hash", T.doc_hash(F.col("text")))
    rest = hashed.join(holdout.select(T.doc_hash(F.col("text")).alias("source_doc_hash")).distinct(), "source_doc_hash", "left_anti")
    found = extract(rest, cfg.min_conf, "source_doc_hash", places=True)
    return found.withColumn("triplet_id", F.concat_ws("-", F.left("source_doc_hash", F.lit(12)), "part", "pos"))


def extract_corpus(docs: DataFrame, holdout: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """:func:`corpus_facts` in order of document hash, pattern and place: ``sub, rel, obj, conf, source_doc_hash, triplet_id, ord``.

    They are written once, as ranges are sampled before rows are dealt to them, and the texts would be searched for both.
    """
    named = cut(corpus_facts(docs, holdout, cfg))
    ranked = with_rank(named, "source_doc_hash", "part", "pos", name="ord")
    drop(named)  # ranges are tables of their own
    return ranked.select("sub", "rel", "obj", "conf", "source_doc_hash", "triplet_id", "ord")


def corpus_stats(triplets: DataFrame) -> DataFrame:
    """One row: documents with a triplet, triplets, relations."""
    return triplets.agg(F.count_distinct("source_doc_hash").alias("docs"), F.count("*").alias("triplets"), F.count_distinct("rel").alias("relations"))


def class_conflicts(triplets: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """Per subject, the first sure fact of each listed class; every two classes contradict.

    ``sub, obj_a, doc_a, obj_b, doc_b, conf_mean``: a is the later fact.
    """
    listed = triplets.where((F.col("rel") == "is_a") & (F.col("conf") >= cfg.min_conf) & F.col("obj").isin(*cfg.classes))
    first = listed.groupBy("sub", "obj").agg(F.min_by(F.struct("ord", "conf", "source_doc_hash"), "ord").alias("f"))
    side = lambda x: first.select("sub", F.col("obj").alias(f"obj_{x}"), F.col("f.ord").alias(f"ord_{x}"), F.col("f.conf").alias(f"conf_{x}"), F.col("f.source_doc_hash").alias(f"doc_{x}"))
    pairs = side("a").join(side("b"), "sub").where("ord_a > ord_b")
    return pairs.select("sub", F.lit("is_a").alias("rel"), "obj_a", "doc_a", "obj_b", "doc_b", rounded((F.col("conf_a") + F.col("conf_b")) / 2, 4).alias("conf_mean"))


def _sides(triplets: DataFrame, cfg: FactConfig) -> DataFrame:
    """``sub, rel, obj, source_doc_hash, conf``: sure facts whose object excludes another; those that repeat are one, with their best confidence."""
    sure = triplets.where((F.col("rel") != "is_a") & (F.col("conf") >= cfg.min_conf) & F.col("obj").isin(*{x for p in cfg.pairs for x in p}))
    return sure.groupBy("sub", "rel", "obj", "source_doc_hash").agg(F.max("conf").alias("conf"))


def _opposites(triplets: DataFrame, cfg: FactConfig, names: tuple[str, str], both: bool) -> DataFrame:
    """The pairs of objects that exclude each other, in one order or both; a handful of rows."""
    listed = [(min(p), max(p)) for p in cfg.pairs] + ([(max(p), min(p)) for p in cfg.pairs] if both else [])
    return F.broadcast(triplets.sparkSession.createDataFrame(listed, f"{names[0]} string, {names[1]} string"))


def exclusive_conflicts(triplets: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """Sure facts of one subject and relation whose objects exclude each other: pairs of sides ``(object, document)``, for a report.

    The pairs of a subject grow with its documents on one side times those on the other; what only asks
    which sides or documents conflict uses :func:`exclusive_sides`.
    """
    sides = _sides(triplets, cfg)
    side = lambda x: sides.select("sub", "rel", F.col("obj").alias(f"obj_{x}"), F.col("source_doc_hash").alias(f"doc_{x}"), F.col("conf").alias(f"conf_{x}"))
    met = side("a").join(_opposites(triplets, cfg, ("obj_a", "obj_b"), False), "obj_a").join(side("b"), ["sub", "rel", "obj_b"])
    return met.select("sub", "rel", "obj_a", "doc_a", "obj_b", "doc_b", rounded((F.col("conf_a") + F.col("conf_b")) / 2, 4).alias("conf_mean"))


def exclusive_sides(triplets: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """``sub, rel, obj, doc`` of every side of an exclusive conflict, each once: no pairs of documents."""
    sides = _sides(triplets, cfg)
    against = sides.select("sub", "rel", F.col("obj").alias("other")).distinct()
    met = sides.join(_opposites(triplets, cfg, ("obj", "other"), True), "obj").join(against, ["sub", "rel", "other"], "left_semi")
    return met.select("sub", "rel", "obj", F.col("source_doc_hash").alias("doc"))


def quarantine(*conflicts: DataFrame) -> DataFrame:
    """Distinct documents of conflicts, given as pairs (``doc_a, doc_b``) or as sides (``doc``); blank hashes are ignored."""
    docs = lambda c: c.select(F.explode(F.array("doc_a", "doc_b")) if "doc_a" in c.columns else F.col("doc")).toDF("source_doc_hash")
    return reduce(DataFrame.union, map(docs, conflicts)).where("coalesce(source_doc_hash, '') <> ''").distinct()


def capped_nodes(triplets: DataFrame, cap: int) -> DataFrame:
    """``node``: the entities of a graph that takes facts in order of ``ord`` (unique) and refuses one that would exceed ``cap`` nodes, with all that it would add.

    Up to the first refusal nodes come in order. It leaves room for one node at most, which the first
    later fact with a single new entity takes. Only about ``cap`` rows pass through one task.
    """
    seen = triplets.select(F.explode(F.array("sub", "obj")).alias("node"), "ord").groupBy("node").agg(F.min("ord").alias("o"))
    first = cut(seen.orderBy("o", "node").limit(cap + 2))  # a fact brings two at most
    counts = first.withColumn("n", F.count("*").over(Window.orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    nodes = cut(counts.where(F.col("n") <= cap).select("node", "o"))
    held, last = nodes.agg(F.count("*"), F.max("o")).first()
    if held >= cap or first.count() == held:
        return nodes.select("node")
    known = lambda c: nodes.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    later = triplets.where(F.col("ord") > F.lit(last if last is not None else -(1 << 62))).join(known("sub"), "sub", "left").join(known("obj"), "obj", "left")
    new = later.where((F.col("_sub").isNull() != F.col("_obj").isNull()) | (F.col("_sub").isNull() & (F.col("sub") == F.col("obj"))))
    one = new.agg(F.min_by(F.when(F.col("_sub").isNull(), F.col("sub")).otherwise(F.col("obj")), "ord").alias("node")).where("node is not null")
    return nodes.select("node").union(one)


def entity_facts(triplets: DataFrame, cap: int) -> DataFrame:
    """The facts that a graph of at most ``cap`` entities takes, with its first relation for their edge: ``sub, obj, rel, conf, source_doc_hash, ord``."""
    nodes = cut(capped_nodes(triplets, cap))
    inside = triplets.join(nodes.withColumnRenamed("node", "sub"), "sub", "left_semi").join(nodes.withColumnRenamed("node", "obj"), "obj", "left_semi")
    edge = inside.groupBy("sub", "obj").agg(F.min_by("rel", "ord").alias("rel"))
    return inside.drop("rel").join(edge, ["sub", "obj"]).select("sub", "obj", "rel", "conf", "source_doc_hash", "ord")


def entity_graph(triplets: DataFrame, cap: int) -> DataFrame:
    """Edges among the entities that the graph takes: ``sub, obj, rel, facts, conf`` (summed), ``docs`` (counted); :func:`entity_facts` lists them, as an edge may have very many."""
    edges = entity_facts(triplets, cap).groupBy("sub", "obj", "rel")
    return edges.agg(F.count("*").alias("facts"), F.sum("conf").alias("conf"), F.count_distinct("source_doc_hash").alias("docs"))


def export_graph(triplets: DataFrame, *conflicts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``s, p, o, consistent``: each fact once, and once per surface verb of its relation; a fact on a side of a conflict (pairs or sides) is inconsistent.

    Facts and sides are dealt once, by subject and object, to as many parts as ``part_rows`` triplets fill, so that what a task
    holds does not grow with the table; in a part they are told apart by what each row says, without a join.
    """
    sides = [c.select("sub", "rel", (F.explode(F.array("obj_a", "obj_b")) if "obj_a" in c.columns else F.col("obj")).alias("obj")) for c in conflicts]
    bad = reduce(DataFrame.union, sides).dropna()  # a null is no side of a conflict
    parts = max(int(triplets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-triplets.count() // part_rows))
    said = triplets.select("sub", "rel", "obj", F.lit(True).alias("_fact")).union(bad.select("sub", "rel", "obj", F.lit(False)))
    facts = said.repartition(parts, "sub", "obj").groupBy("sub", "rel", "obj").agg(F.max("_fact").alias("_fact"), F.min("_fact").alias("c")).where("_fact")
    verbs = F.create_map(*[x for rel, names in ALIASES.items() for x in (F.lit(rel), F.array(*map(F.lit, names)))])
    every = F.explode(F.concat(F.array("rel"), F.coalesce(F.try_element_at(verbs, F.col("rel")), F.array().cast("array<string>"))))
    out = facts.select(F.col("sub").alias("s"), every.alias("p"), F.col("obj").alias("o"), "c")
    return out.groupBy("s", "p", "o").agg(F.min("c").alias("consistent"))


def claim_status(claims: DataFrame, triplets: DataFrame, cfg: FactConfig = FACTS, key: str = "sentence_id") -> DataFrame:
    """``key, status`` from ``claims(key, sub, rel, obj)``: the worst of ok, unverified, contradicts over a sentence's claims.

    A claim is unverified without known objects, ok if its object is known, and contradicts if a known
    object excludes it, by class or as a listed pair. A claim with null sub makes its sentence ok.
    """
    facts = cut(triplets.select("sub", "rel", "obj").distinct())
    claim = [key, "sub", "rel", "obj"]
    asked = cut(claims.where("sub is not null").select(*claim).distinct())
    classes = F.array(*map(F.lit, cfg.classes))
    against = F.create_map(*[F.lit(x) for a, b in cfg.pairs for x in (a, b, b, a)])
    opposite = F.try_element_at(against, F.col("obj"))
    rivals = F.when((F.col("rel") == "is_a") & F.array_contains(classes, F.col("obj")), F.array_except(classes, F.array("obj")))
    clashing = F.concat(F.array_compact(F.array(opposite)), F.coalesce(rivals, F.array().cast("array<string>")))
    # each claim asks for its own object and for the few that exclude it, so no list of a subject's objects is needed
    probes = asked.select(*claim, F.explode(F.concat(F.array(F.struct(F.col("obj").alias("x"), F.lit(True).alias("same"))), F.transform(clashing, lambda x: F.struct(x.alias("x"), F.lit(False).alias("same"))))).alias("p"))
    met = probes.select(*claim, "p.*").join(facts.withColumnRenamed("obj", "x"), ["sub", "rel", "x"], "left_semi")
    found = met.groupBy(*claim).agg(F.max("same").alias("same"), F.max(~F.col("same")).alias("clash"))
    rank = F.when(F.col("same"), 0).when(F.col("clash"), 2).otherwise(1)
    worst = asked.join(found, claim, "left").select(key, rank.alias("r")).unionByName(claims.where("sub is null").select(key, F.lit(0).alias("r"))).groupBy(key).agg(F.max("r").alias("r"))
    return worst.select(key, F.element_at(F.array(F.lit("ok"), F.lit("unverified"), F.lit("contradicts")), F.col("r") + 1).alias("status"))


def run_stats(triplets: DataFrame, cfg: FactConfig = FACTS) -> DataFrame:
    """One row: triplets, contradictions, quarantined documents. Exclusive pairs are counted from the sizes of their sides."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    classes, sizes = class_conflicts(triplets, cfg), cut(_sides(triplets, cfg).groupBy("sub", "rel", "obj").agg(F.count("*").alias("n")))
    a, b = sizes.select("sub", "rel", F.col("obj").alias("x"), F.col("n").alias("na")), sizes.select("sub", "rel", F.col("obj").alias("y"), F.col("n").alias("nb"))
    pairs = a.join(_opposites(triplets, cfg, ("x", "y"), False), "x").join(b, ["sub", "rel", "y"])
    exclusive = pairs.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("_e"))
    found = one(classes, "_c").crossJoin(exclusive).select((F.col("_c") + F.col("_e")).alias("contradictions"))  # one row each
    return one(triplets, "triplets").crossJoin(found).crossJoin(one(quarantine(classes, exclusive_sides(triplets, cfg)), "quarantined_docs"))
