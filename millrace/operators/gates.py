"""Promotion gates, vetoes, audits and experiment treatments, as columns over metric and log tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import GATE, GateConfig
from millrace.lineage import cut
from millrace.operators.reports import relative_gain
from millrace.operators.splits import strided


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def promotion(m: DataFrame, cfg: GateConfig = GATE) -> DataFrame:
    """Adds ``promote, abort, cause`` from ``ppl, champ_ppl, diversity, champ_diversity, digest, expected_digest``.

    Rules in order: digest mismatch aborts; no perplexity rejects; no champion promotes; too small a
    gain, then too large a diversity drop (only if both are known and the champion's is positive), reject.
    A champion at 0 makes the gain minus infinity, which rejects, or NaN against a candidate at 0, which is no gain below the least.
    """
    gain = relative_gain(F.col("ppl"), F.col("champ_ppl"))
    drop = F.when(F.col("champ_diversity") > 0, (F.col("champ_diversity") - F.col("diversity")) / F.col("champ_diversity"))
    verdict = lambda p, a, cause: F.struct(F.lit(p).alias("promote"), F.lit(a).alias("abort"), cause.alias("cause"))
    result = (
        F.when(~F.col("digest").eqNullSafe(F.col("expected_digest")), verdict(False, True, F.lit("holdout digest mismatch")))
        .when(F.col("ppl").isNull(), verdict(False, False, F.lit("no perplexity")))
        .when(F.col("champ_ppl").isNull(), verdict(True, False, F.lit("no champion")))
        .when(gain < cfg.min_gain, verdict(False, False, F.format_string(f"gain %.4f < {cfg.min_gain}", gain)))
        .when(F.coalesce(drop > cfg.max_diversity_drop, F.lit(False)), verdict(False, False, F.format_string(f"diversity drop %.4f > {cfg.max_diversity_drop}", drop)))
        .otherwise(verdict(True, False, F.format_string("gain %.4f", gain)))
    )
    return m.withColumn("_v", result).select(*m.columns, "_v.*")


def topology_veto(m: DataFrame, cfg: GateConfig = GATE) -> DataFrame:
    """Adds ``veto, establish_baseline, causes, checks`` from ``round_id, has_champion, bottleneck_h0, bottleneck_h1, gain, b0, baseline_b0, cycles, champ_cycles``.

    The first round, or one without a champion, sets the baseline. R1: churn without an excusing gain.
    R2: components under a share of the baseline. R3: cycles over the champion's by more than the
    allowed growth. Rules whose inputs are missing are skipped; all causes are listed.
    """
    first = (F.col("round_id") == 1) | ~F.coalesce("has_champion", F.lit(False))
    observed = F.greatest("bottleneck_h0", "bottleneck_h1")
    no = lambda c: F.coalesce(c, F.lit(False))
    r1 = no((observed > cfg.churn_bottleneck) & ~(F.col("gain") >= cfg.churn_excuse))
    r2 = no((F.col("baseline_b0") > 0) & (F.col("b0") < cfg.collapse_ratio * F.col("baseline_b0")))
    r3 = no(F.col("cycles") > (1 + cfg.cycle_growth) * F.col("champ_cycles"))
    causes = F.when(first, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(r1, "R1"), F.when(r2, "R2"), F.when(r3, "R3"))))
    checks = F.struct(
        F.struct(observed.alias("observed"), F.lit(cfg.churn_bottleneck).alias("threshold"), F.col("gain")).alias("R1_churn"),
        F.struct(F.col("b0"), (cfg.collapse_ratio * F.col("baseline_b0")).alias("floor")).alias("R2_collapse"),
        F.struct(F.col("cycles"), ((1 + cfg.cycle_growth) * F.col("champ_cycles")).alias("ceiling")).alias("R3_graph"),
    )
    return m.withColumns({"causes": causes, "checks": checks, "establish_baseline": first}).withColumn("veto", F.size("causes") > 0)


def composite(ns_promote: Column | str, abort: Column | str, veto: Column | str) -> tuple[Column, Column]:
    """(final promotion, star case): promoted by metrics, not aborted, not vetoed; starred where only the veto stood against it."""
    p, a, v = (F.coalesce(_c(x), F.lit(False)) for x in (ns_promote, abort, veto))
    return p & ~a & ~v, p & ~a & v


def veto_lookup(rounds: DataFrame, topo: DataFrame, *key: str, order: str = "ord") -> DataFrame:
    """Adds ``veto, causes`` of the first log row of each round; (false, []) without one."""
    first = topo.groupBy(*key).agg(F.min_by(F.struct("veto", "causes"), order).alias("_t"))
    j = rounds.join(first, list(key), "left")
    return j.select(*rounds.columns, F.coalesce("_t.veto", F.lit(False)).alias("veto"), F.coalesce("_t.causes", F.array().cast("array<string>")).alias("causes"))


def unmeasured(decisions: DataFrame, topo: DataFrame, *key: str) -> DataFrame:
    """Decisions from the second round on without a measurement."""
    return decisions.where("round_id >= 2").join(topo.select(*key, "round_id").distinct(), [*key, "round_id"], "left_anti")


def fail_closed(decisions: DataFrame, topo: DataFrame, *key: str) -> None:
    row = unmeasured(decisions, topo, *key).limit(1).collect()
    if row:
        raise RuntimeError(f"round {row[0]['round_id']} has no topology measurement")


def integrity(topo: DataFrame, decisions: DataFrame, run: str = "run_id") -> DataFrame:
    """``run, check, detail`` of every violation.

    V1 more than one threshold hash, or rounds without one; V2 normal rounds with several treatments,
    or a stress round with a normal one's; V3 a champion that changed behind a veto; V4 a decision
    without a measurement or the reverse; V5 several baselines, or one that is not first.
    """
    out = lambda df, check, detail: df.select(run, F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    per = topo.groupBy(run).agg(
        (F.count_distinct("config_sha256") + F.max(F.col("config_sha256").isNull().cast("int"))).alias("configs"),
        F.count_if(F.coalesce("config_sha256", F.lit("")) == "").alias("without"),
        F.count_distinct(F.when(F.col("stress_mode").isNull(), F.col("treatment_sha256"))).alias("treatments"),
        F.count_if(F.coalesce("establish_baseline", F.lit(False))).alias("baselines"),
        F.min("round_id").alias("first"),
        F.min(F.when(F.col("establish_baseline"), F.col("round_id"))).alias("baseline"),
    )
    normal = topo.where("stress_mode is null").select(run, "treatment_sha256").distinct()
    reused = topo.where("stress_mode is not null").join(normal, [run, "treatment_sha256"], "left_semi")
    w = Window.partitionBy(run).orderBy("round_id")
    champions = topo.withColumn("_next", F.lead("champion_sha256").over(w)).withColumn("_id", F.lead("round_id").over(w))
    moved = champions.where(F.coalesce("veto", F.lit(False)) & ~F.coalesce("establish_baseline", F.lit(False)) & F.col("_id").isNotNull() & ~F.col("champion_sha256").eqNullSafe(F.col("_next")))
    undecided = topo.join(decisions.select(run, "round_id").distinct(), [run, "round_id"], "left_anti")
    parts = [
        out(per.where("configs > 1"), "V1 drift", F.col("configs")),
        out(per.where("configs <= 1 and without > 0"), "V1 missing", F.col("without")),
        out(per.where("treatments > 1"), "V2 normal", F.col("treatments")),
        out(reused.groupBy(run).agg(F.count("*").alias("n")), "V2 stress", F.col("n")),
        out(moved, "V3 champion", F.col("_id")),
        out(unmeasured(decisions, topo, run), "V4 decision", F.col("round_id")),
        out(undecided, "V4 topo", F.col("round_id")),
        out(per.where("baselines > 1"), "V5 count", F.col("baselines")),
        out(per.where("baseline <> first"), "V5 first", F.col("baseline")),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def round_metrics(log: DataFrame, round_id: int) -> DataFrame:
    """The rows of one round; an error if there is none."""
    found = log.where(F.col("round_id") == round_id)
    if found.limit(1).count() == 0:
        raise LookupError(f"no metrics of round {round_id}")
    return found


def inventory_hash(files: DataFrame, *by: str, name: str = "name", size: str = "bytes", as_name: str = "treatment_sha256") -> DataFrame:
    """One hash over the names and sizes of each group, whatever their order and number: the sha256 of the count and of the sums of all lines' hashes, in four parts of 60 bits.

    Sums are aggregated in parallel, so no row or task holds all names. Any line that changes, comes or
    goes changes the hash; its value differs from a hash over the sorted lines.
    """
    line = F.sha2(F.concat_ws("\t", F.col(name).cast("string"), F.col(size).cast("string")).cast("binary"), 256)
    parts = files.select(*by, line.alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(4)]
    summed = parts.groupBy(*by).agg(F.count("*").alias("_n"), *sums)
    text = F.concat_ws("-", "_n", *[F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return summed.select(*by, F.sha2(text.cast("binary"), 256).alias(as_name))


def treatment_hash(files: DataFrame, holdout_digest: str, triplets: DataFrame, manifest: str, stress: DataFrame | None = None, settings: dict | None = None) -> str:
    """sha256 of everything a round trains on: the corpus inventory, the holdout's digest and the extraction's settings, the triplets, the rate manifest and the files of a stress treatment.

    ``files`` and ``stress`` have names and sizes (of ``stress`` also ``sha256``, where known); what is
    read on the driver is one row for each part.
    """
    out = hashlib.sha256()
    out.update(corpus_inventory(files, holdout_digest, settings).encode())
    rows = triplets.select(F.to_json(F.struct(*sorted(triplets.columns))).alias("name"), F.lit(0).alias("bytes"))
    out.update(inventory_hash(rows).first()[0].encode())
    out.update(manifest.encode())
    if stress is not None:
        out.update(inventory_hash(stress, size="sha256" if "sha256" in stress.columns else "bytes").first()[0].encode())
    return out.hexdigest()


def corpus_inventory(files: DataFrame, holdout_digest: str, settings: dict | None = None) -> str:
    """sha256 that names a corpus snapshot: names and sizes, the holdout's digest, the extraction's settings."""
    head = json.dumps({"files": inventory_hash(files).first()[0], "holdout": holdout_digest, "settings": settings or {}}, sort_keys=True)
    return hashlib.sha256(head.encode()).hexdigest()


def dup_flood(docs: DataFrame, ratio: float, order: str = "rank") -> DataFrame:
    """Documents plus cyclic copies, so that ``ratio`` of the result are copies: ``i, rank, copy``. ``order`` counts rows from 1."""
    n = docs.count()
    total = int(n / (1 - ratio))
    picks = docs.sparkSession.range(total).select(F.col("id").alias("i"), (F.pmod("id", F.lit(n)) + 1).alias(order), (F.col("id") >= n).alias("copy"))
    return picks.join(docs, order)


def flood_size(k: int) -> int:
    return min(600, max(50, k // 2))


def contradiction_flood(triplets: DataFrame, top_k: int, seed: int, conf: float = 0.99) -> DataFrame:
    """``triplets`` and planted is_a triangles among the nodes of largest degree (repeated facts count): ``sub, rel, obj, conf, triplet_id, planted``.

    The three corners of each triangle are distinct, drawn by seeded hashes; with fewer than three nodes none is planted.
    """
    isa = triplets.where("rel = 'is_a'")
    degree = isa.select(F.explode(F.array("sub", "obj")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    top = cut(degree.orderBy(F.desc("d"), "node").limit(top_k))
    ranked = top.withColumn("i", F.row_number().over(Window.orderBy(F.desc("d"), "node")) - 1)  # top_k rows
    k = top.count()
    draw = lambda j: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{j}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(max(1, k - j)))
    # each draw is a place among the nodes that are left, in order
    picks = triplets.sparkSession.range(flood_size(k) if k >= 3 else 0).select("id", *[draw(j).alias(f"d{j}") for j in range(3)])
    picks = picks.withColumn("p0", F.col("d0")).withColumn("p1", F.col("d1") + (F.col("d1") >= F.col("d0")).cast("long"))
    low, high = F.least("p0", "p1"), F.greatest("p0", "p1")
    second = F.col("d2") + (F.col("d2") >= low).cast("long")
    picks = picks.withColumn("p2", second + (second >= high).cast("long"))
    for j in range(3):
        picks = picks.join(F.broadcast(ranked.select(F.col("i").cast("long").alias(f"p{j}"), F.col("node").alias(f"n{j}"))), f"p{j}")
    side = F.explode(F.array(*[F.struct(F.col(f"n{a}").alias("sub"), F.col(f"n{b}").alias("obj"), F.lit(a).alias("e")) for a, b in ((0, 1), (1, 2), (2, 0))])).alias("s")
    name = F.concat(F.lit("planted-"), F.col("id").cast("string"), F.lit("-"), F.col("s.e").cast("string"))
    planted = picks.select("id", side).select("s.sub", F.lit("is_a").alias("rel"), "s.obj", F.lit(conf).alias("conf"), name.alias("triplet_id"), F.lit(True).alias("planted"))
    return triplets.select("sub", "rel", "obj", "conf", "triplet_id", F.lit(False).alias("planted")).unionByName(planted)


def lr_spike(docs: DataFrame, order: str, key: str, share: float = 0.1, multiplier: float = 10.0) -> DataFrame:
    """A strided share of the documents, to be trained with a multiplied rate."""
    return strided(docs, max(1, int(docs.count() * share)), order, key).withColumn("lr_multiplier", F.lit(multiplier))


def treatment_manifest(kind: str, **settings) -> str:
    """Deterministic JSON of a treatment."""
    return json.dumps({"kind": kind, **settings}, sort_keys=True, separators=(",", ":"))


def damage(candidate_ppl: Column | str, champion_ppl: Column | str, ratio: float = GATE.damage_ratio) -> Column:
    return F.when(F.coalesce(_c(candidate_ppl) > ratio * _c(champion_ppl), F.lit(False)), "damage evidence").otherwise("no verdict")


def human_gate(round_id: Column | str, every: int = GATE.human_gate_every, auto: bool = False) -> Column:
    return F.lit(False) if auto else (_c(round_id) % every == 0)


# What a prompt suite declares, holds, and asks of each prompt.
SUITE_VERSION, SUITE_SECTIONS, SUITE_FIELDS = 1, ("defaults", "prompts"), ("id", "category", "prompt", "review_note")


def suite_errors(prompts: DataFrame, required: tuple[str, ...] = SUITE_FIELDS, key: str = "id") -> DataFrame:
    """``key, error``: repeated ids and missing required fields; a column that is not there is missing in every row."""
    repeated = prompts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate id").alias("error"))
    value = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in prompts.columns else F.lit("")
    missing = prompts.select(key, F.explode(F.array_compact(F.array(*[F.when(value(c) == "", f"missing {c}") for c in required]))).alias("error"))
    return repeated.unionByName(missing)


def checked_suite(suite: DataFrame, required: tuple[str, ...] = SUITE_FIELDS) -> DataFrame:
    """The prompts of ``suite(schema_version, defaults map, prompts array of structs)``, one row, each with its parameters: the defaults, overridden by its own.

    An error for a wrong version, a missing section, a repeated id or a missing field. A prompt's
    ``params`` map, where it has one, overrides only what the defaults name.
    """
    if missing := [c for c in SUITE_SECTIONS if c not in suite.columns]:
        raise ValueError(f"the suite lacks {missing}")
    if "schema_version" not in suite.columns or (version := suite.first()["schema_version"]) != SUITE_VERSION:
        raise ValueError(f"unsupported version {version if 'schema_version' in suite.columns else None}")
    prompts = suite.select("defaults", F.inline("prompts"))
    if found := suite_errors(prompts, required).orderBy("id", "error").limit(1).collect():
        raise ValueError(f"prompt {found[0]['id']}: {found[0]['error']}")
    own = F.col("params") if "params" in prompts.columns else F.lit(None).cast("map<string,string>")
    named = F.map_filter(own, lambda k, _: F.map_contains_key(F.col("defaults"), k))
    return prompts.withColumn("params", with_overrides(F.col("defaults"), named)).drop("defaults")


def with_overrides(defaults: Column, overrides: Column) -> Column:
    """Defaults overridden key by key."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(F.coalesce(overrides, F.create_map().cast("map<string,string>")), k)), F.coalesce(overrides, F.create_map().cast("map<string,string>")))


def fit_profile(need_mb: Column, free_mb: Column, micro: Column, accumulate: Column) -> Column:
    """Halves the micro batch and doubles accumulation until it fits: ``(micro, accumulate, fits)`` in closed form."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(F.floor(micro / F.pow(F.lit(2), i)).cast("int").alias("micro"), (accumulate * F.pow(F.lit(2), i)).cast("int").alias("accumulate"), (need_mb / F.pow(F.lit(2), i) <= free_mb).alias("fits")))
    ok = F.filter(steps, lambda s: s["fits"] & (s["micro"] >= 1))
    last = F.filter(steps, lambda s: s["micro"] >= 1)
    return F.when(F.size(ok) > 0, F.element_at(ok, 1)).otherwise(F.element_at(last, -1))


def resolve_profile(ram_gb: Column, ladder: tuple[tuple[float, str], ...] = ((48.0, "large"), (12.0, "small"), (0.0, "nano"))) -> Column:
    """The first profile whose memory threshold is met."""
    out = F.lit(ladder[-1][1])
    for least, name in reversed(ladder[:-1]):
        out = F.when(ram_gb >= least, name).otherwise(out)
    return out
