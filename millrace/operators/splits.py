"""Holdouts, splits, replay, samples, packing and schedules."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.order import dealt_ranges, keep_top_share, with_rank, with_running_sum
from millrace.lineage import cut
from millrace.sources.files import exists


def freeze_holdout(docs: DataFrame, fraction: float = 0.02) -> DataFrame:
    """The rows to hold out: the smallest content hashes, at least one row."""
    if docs.limit(1).count() == 0:
        raise ValueError("no documents to hold out")
    return keep_top_share(docs.withColumn("hash", T.doc_hash(F.col("text"))), fraction, "hash", "doc_id", key="doc_id")


def freeze(docs: DataFrame, path: str, fraction: float = 0.02, name: str = "doc_id") -> dict:
    """Splits the holdout off once: writes it to ``path/holdout`` and its digest beside it, the remaining rows to ``path/rest``.

    A second call changes nothing and answers ``already-frozen``; an error if the stored rows no longer
    have the stored digest, or if there are no documents. Returns status, docs and sha256.
    """
    spark = docs.sparkSession
    stored = lambda: spark.read.parquet(f"{path}/holdout")
    digest = lambda: holdout_digest(stored().select(F.col(name).cast("string").alias("name"), F.col("text").alias("content")))
    tree = lambda: digest_tree(stored().select(F.col(name).cast("string").alias("name"), F.col("text").alias("content")))
    if exists(spark, f"{path}/anchor"):
        expected, actual = spark.read.text(f"{path}/anchor").first()[0], digest()
        if actual != expected:
            where = [r["prefix"] for r in changed_ranges(spark.read.parquet(f"{path}/tree"), tree()).orderBy("prefix").limit(8).collect()] if exists(spark, f"{path}/tree") else []
            raise RuntimeError(f"the holdout's digest is {actual}, the anchor says {expected}: it may not be made again; ranges of name hashes that changed: {', '.join(where) or 'unknown'}")
        return {"status": "already-frozen", "docs": stored().count(), "sha256": expected}
    held = freeze_holdout(docs, fraction)
    held.write.mode("overwrite").parquet(f"{path}/holdout")
    docs.join(stored().select(name), name, "left_anti").write.mode("overwrite").parquet(f"{path}/rest")
    tree().coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
    found = digest()
    spark.createDataFrame([(found,)], "value string").coalesce(1).write.text(f"{path}/anchor")  # last, so that a broken attempt is made again
    return {"status": "frozen", "docs": stored().count(), "sha256": found}


def holdout_digest(files: DataFrame, name: str = "name", content: str = "content") -> str:
    """sha256 over each name, a zero byte and the bytes, in order of names.

    The value is defined by one pass over all bytes, so they stream through the driver, one partition
    at a time: for holdouts, which are small. :func:`parallel_digest` hashes contents on the executors.
    """
    rows = files.select(F.col(name).cast("string"), F.col(content).cast("binary")).orderBy(F.col(name).cast("string").cast("binary")).toLocalIterator()
    out, n = hashlib.sha256(), 0
    for r in rows:
        out.update(r[0].encode() + b"\0" + bytes(r[1]))
        n += 1
    if not n:
        raise ValueError("empty holdout")
    return out.hexdigest()


def digest_tree(files: DataFrame, depth: int = 2, name: str = "name", content: str = "content") -> DataFrame:
    """``level, prefix, files, digest``: a hash tree of named contents; the root is level 0, with the empty prefix.

    A file's leaf is the sha256 of its name, a zero byte and its content's sha256; leaves lie in 16^``depth`` ranges by the first
    digits of their name's sha256, so a file stays in its range whatever else is there. A range hashes its leaves in order of names, and a
    level above hashes at most 16 rows a row. All of it runs on the executors; choose ``depth`` so that a range's leaves (some 100 bytes each) fit a task.
    Files of the same name and content count as often as they occur; an empty table has no rows.
    """
    leaf = F.sha2(F.concat(F.col(name).cast("string").cast("binary"), F.lit(b"\0"), F.unhex(F.sha2(F.col(content).cast("binary"), 256))), 256)
    leaves = files.select(F.col(name).cast("string").alias("name"), leaf.alias("leaf"), F.left(F.sha2(F.col(name).cast("string").cast("binary"), 256), F.lit(depth)).alias("prefix"))
    join = lambda rows, of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*rows))), lambda r: r[of]), "").cast("binary"), 256)
    level = cut(leaves.groupBy("prefix").agg(F.count("*").alias("files"), join(("name", "leaf"), "leaf").alias("digest")))
    out = level.select(F.lit(depth).alias("level"), "prefix", "files", "digest")
    for k in range(depth - 1, -1, -1):
        up = level.select(F.left("prefix", F.lit(k)).alias("up"), "prefix", "files", "digest").groupBy("up").agg(F.sum("files").alias("files"), join(("prefix", "digest"), "digest").alias("digest"))
        level = up.select(F.col("up").alias("prefix"), "files", "digest")
        out = out.union(level.select(F.lit(k).alias("level"), "prefix", "files", "digest"))
    return cut(out)


def parallel_digest(files: DataFrame, name: str = "name", content: str = "content", depth: int = 2) -> str:
    """Changes with any name or byte like :func:`holdout_digest`, with another value: the root of :func:`digest_tree`, the only row that reaches the driver."""
    root = digest_tree(files, depth, name, content).where("level = 0").first()
    if root is None:
        raise ValueError("empty holdout")
    return root["digest"]


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``prefix, before, after`` of the lowest ranges of two digest trees of one depth that differ: where a file was changed, added or lost. Null digests for ranges that one lacks."""
    low = lambda tree, of: tree.join(F.broadcast(tree.agg(F.max("level").alias("level"))), "level", "left_semi").select("prefix", F.col("digest").alias(of))
    return low(before, "before").join(low(after, "after"), "prefix", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def verify_holdout(files: DataFrame, expected: str | None, **kw) -> str:
    """Fails unless the digest is the expected one."""
    if not expected:
        raise RuntimeError("no holdout digest is set")
    actual = holdout_digest(files, **kw)
    if actual != expected:
        raise RuntimeError(f"holdout digest is {actual}, expected {expected}")
    return actual


def train_val(docs: DataFrame, fraction: float, order: str, holdout: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Adds ``split``: the last max(1, rounded share) rows by ``order`` are val; held-out rows are excluded."""
    rest = docs if holdout is None else docs.join(holdout.select(key).distinct(), key, "left_anti")
    n = rest.count()
    val = max(1, round(fraction * n))
    return with_rank(rest, order, key).withColumn("split", F.when(F.col("rank") > n - val, "val").otherwise("train")).drop("rank")


def not_quarantined(docs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Excludes documents by the first 12 characters of their hash."""
    return docs.join(quarantine.select(F.col("source_doc_hash").substr(1, 12).alias("_q")).distinct(), F.col("hash").substr(1, 12) == F.col("_q"), "left_anti")


def replay_key(name: Column, round_id: int) -> Column:
    return F.crc32(name.cast("binary")).bitwiseXOR(F.lit(round_id * 0x9E3779B9)).bitwiseAND(F.lit(0xFFFFFFFF))


def replay(docs: DataFrame, fraction: float, round_id: int, fresh: Column, name: str = "name", score: Column | None = None) -> DataFrame:
    """Fresh rows and a stable share of the others: the smallest keys of the round."""
    flagged = docs.withColumn("_fresh", fresh)
    history = flagged.where(~F.col("_fresh"))
    n = history.count()
    keep = round(fraction * n)
    if fraction >= 1 or keep >= n:
        return docs
    ranked = with_rank(history.withColumn("_key", replay_key(F.col(name), round_id) if score is None else score), "_key", name)
    return flagged.where("_fresh").drop("_fresh").unionByName(ranked.where(F.col("rank") <= keep).drop("_fresh", "_key", "rank"))


def seeded_sample(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """``k`` rows by smallest md5 of seed and key: the same whatever the partitioning."""
    chosen = rows.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")).alias("_h")).orderBy("_h", key).limit(k)
    return rows.join(chosen.select(key), key, "left_semi")


def budgeted(files: DataFrame, budget: int, seed: int, name: str = "name", size: str = "bytes", parts: int | None = None) -> DataFrame:
    """Files in seeded order while they fit into a byte budget; one that does not fit is skipped and later ones are tried.

    Each round settles a whole class of sizes: while at least 2^k bytes are left, but not twice as many, larger classes are
    out, smaller files all fit, and the class itself has room for one. So running sums of the smaller files find the place
    where less than 2^k are left, and there are at most as many rounds, of one job each, as the budget has binary digits.
    Ranges of the order are summed in parallel; one row per range passes through one task. Files of equal names are taken or left together; null sizes are left.
    """
    spark = files.sparkSession
    sized = files.select(F.col(name).alias("name"), F.col(size).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")).cast("binary")).alias("h"))
    dealt = dealt_ranges(sized.where("size is not null"), ["h", "name"], parts)
    spans, at, left = [], -1, budget  # (after, up to, sizes below), and single files of a class as spans of their own
    while left >= 0:
        least = 1 << (left.bit_length() - 1) if left else 1
        rows = dealt.where((F.col("_at") > at) & (F.col("size") < (2 * least if left else 1))).withColumn("_small", F.when(F.col("size") < least, F.col("size")).otherwise(0))
        sums = rows.groupBy("_part").agg(F.sum("_small").alias("_sum"))
        before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_base"))  # a row per range
        upto = F.col("_base") + F.sum("_small").over(Window.partitionBy("_part").orderBy("_at"))
        here = rows.join(F.broadcast(before), "_part").withColumn("_left", F.lit(left) - upto - F.when(F.col("size") >= least, F.col("size")).otherwise(0))
        ends = (F.col("_left") < least) & ((F.col("size") < least) | (F.col("_left") >= 0))
        met = here.where(ends).agg(F.min(F.struct("_at", "_left", "size"))).first()[0] if left else None
        spans.append((at, met["_at"] if met else 1 << 62, least))
        if not met:
            break
        if met["size"] >= least:
            spans.append((met["_at"] - 1, met["_at"], 1 << 62))
        at, left = met["_at"], met["_left"]
    taken = F.lit(False)
    for after, last, below in spans:
        taken = taken | ((F.col("_at") > after) & (F.col("_at") <= last) & (F.col("size") < below))
    chosen = dealt.where(taken).select(F.col("name").alias(name))
    return files.join(chosen, name, "left_semi")


def probe_sentences(docs: DataFrame, k: int, seed: int, min_chars: int = 40, min_tokens: int = 8, max_tokens: int = 256) -> DataFrame:
    """``k`` distinct sentences of fitting length; an error if there are too few."""
    pieces = docs.select(F.explode(T.sentences(F.col("text"))).alias("sentence")).select(T.strip(F.col("sentence")).alias("sentence"))
    n = F.size(F.filter(F.split("sentence", r"\s+", -1), lambda x: x != ""))
    fit = pieces.where((F.length("sentence") >= min_chars) & n.between(min_tokens, max_tokens)).distinct()
    out = fit.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("sentence")).cast("binary"))).orderBy("_h", "sentence").limit(k)
    return out.select("sentence", F.when(F.count("*").over(Window.partitionBy()) < k, F.raise_error(F.lit("too few sentences")).cast("int")).alias("_ok")).where("_ok is null").drop("_ok")


def create_probes(docs: DataFrame, path: str, k: int, seed: int, min_chars: int = 40, min_tokens: int = 8, max_tokens: int = 256) -> dict:
    """Chooses the probe sentences once and for all: later calls change nothing and answer what was stored.

    Writes ``path/sentences`` (``ord, sentence``, in order of text) and, last, ``path/probes`` with their sha256 (of the sentences
    joined by line breaks; ``k`` of them reach the driver), the numbers of candidates and of sentences over ``max_tokens``, the limit and the seed. An attempt
    that broke before the last step is made again; an error if there are too few sentences.
    """
    spark = docs.sparkSession
    if not exists(spark, f"{path}/probes/_SUCCESS"):
        pieces = docs.select(F.explode(T.sentences(F.col("text"))).alias("sentence")).select(T.strip(F.col("sentence")).alias("sentence")).where(F.length("sentence") >= min_chars)
        n = F.size(F.filter(F.split("sentence", r"\s+", -1), lambda x: x != ""))
        seen = pieces.agg(F.count_distinct(F.when(n.between(min_tokens, max_tokens), F.xxhash64("sentence"))).alias("candidates"), F.count_if(n > max_tokens).alias("discarded_overlong")).first()
        chosen = probe_sentences(docs, k, seed, min_chars, min_tokens, max_tokens).orderBy("sentence")
        sentences = [r["sentence"] for r in chosen.collect()]
        spark.createDataFrame(list(enumerate(sentences)), "ord int, sentence string").coalesce(1).write.mode("overwrite").parquet(f"{path}/sentences")
        row = (_sentences_digest(sentences), k, seen["candidates"], seen["discarded_overlong"], max_tokens, seed)
        spark.createDataFrame([row], "sha256 string, sentences int, candidates long, discarded_overlong long, max_tokens int, seed long").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    load_probes(spark, path)
    return spark.read.parquet(f"{path}/probes").first().asDict()


def _sentences_digest(sentences: list[str]) -> str:
    return hashlib.sha256("\n".join(sentences).encode()).hexdigest()


def load_probes(spark: SparkSession, path: str) -> DataFrame:
    """``ord, sentence`` of the stored probes; an error if there are none, or if they no longer have their digest."""
    if not exists(spark, f"{path}/probes/_SUCCESS"):
        raise RuntimeError(f"no probe sentences at {path}: create them once before anything is measured")
    stored = spark.read.parquet(f"{path}/sentences").orderBy("ord")
    expected, actual = spark.read.parquet(f"{path}/probes").first()["sha256"], _sentences_digest([r["sentence"] for r in stored.collect()])
    if actual != expected:
        raise RuntimeError(f"the probes' digest is {actual}, expected {expected}")
    return stored


def strided(rows: DataFrame, keep: int, order: str, key: str) -> DataFrame:
    """Rows floor(i * n / keep) of the ordered table, i from 0."""
    n = rows.count()
    picks = rows.sparkSession.range(min(keep, n)).select((F.floor(F.col("id") * n / F.lit(float(min(keep, n) or 1))) + 1).cast("long").alias("rank")).distinct()
    return with_rank(rows, order, key).join(picks, "rank", "left_semi").drop("rank")


def pack(docs: DataFrame, window: int, order: str, end: int | None = None, pad: int = 0, tokens: Column | None = None) -> DataFrame:
    """``window_id, tokens, flags`` from ``docs(order, tokens array<int>)``: concatenated in order, cut, the tail padded; flags mark starts.

    A document is cut into its piece of each window that it meets; a window is at most ``window`` pieces. ``tokens``, where given, makes them from
    the other columns of ``docs`` once rows are dealt to their ranges: the ranges' bounds are sampled first, which works out whatever is there once more.
    """
    toks = F.col("tokens") if tokens is None else tokens
    toks = F.concat(toks, F.array(F.lit(end))) if end is not None else toks
    sized = lambda dealt: dealt.select(order, toks.alias("tokens"), "_at", "_part").withColumn("_n", F.greatest(F.size("tokens").cast("long"), F.lit(0)))
    # rows of none go once they are written: a filter of what is not written yet would work the tokens out again
    placed = with_running_sum(docs, "_n", order, name="_before", made=sized).where("_n > 0")
    first, last = F.expr(f"_before div {window}"), F.expr(f"(_before + _n - 1) div {window}")

    def piece(w: Column) -> Column:
        start = F.greatest(w * window - F.col("_before"), F.lit(0))  # in the document
        stop = F.least((w + 1) * window - F.col("_before"), F.col("_n"))
        at = F.greatest(F.col("_before") - w * window, F.lit(0)).cast("int")
        return F.struct(w.alias("window_id"), F.struct(at.alias("at"), (start == 0).alias("starts"), F.slice("tokens", (start + 1).cast("int"), (stop - start).cast("int")).alias("tokens")).alias("p"))

    pieces = placed.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("x")).select("x.*")
    w = pieces.groupBy("window_id").agg(F.sort_array(F.collect_list("p")).alias("x"))
    flags = lambda p: F.concat(F.array(p["starts"].cast("int")), F.array_repeat(F.lit(0), F.size(p["tokens"]) - 1))
    filled = lambda parts, v: F.get(F.transform(F.array(F.flatten(parts)), lambda a: F.concat(a, F.array_repeat(F.lit(v), F.lit(window) - F.size(a)))), 0)
    return w.select("window_id", filled(F.transform("x", lambda p: p["tokens"]), pad).alias("tokens"), filled(F.transform("x", flags), 0).alias("flags"))


def segments(windows: DataFrame) -> DataFrame:
    """Document number of each position: the running sum of flags; equal numbers see each other. Built from the stretches between flags."""

    def numbered(starts: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), starts, F.array(F.size("flags")))
        runs = lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.array_repeat(i, F.get(b, i + 1) - F.get(b, i))))
        return F.get(F.transform(F.array(bounds), runs), 0)

    starts = F.filter(F.transform("flags", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return windows.select("window_id", F.get(F.transform(F.array(starts), numbered), 0).alias("segments"))


def same_document(segments: Column, i: Column, j: Column) -> Column:
    return F.element_at(segments, i + 1) == F.element_at(segments, j + 1)


def wraparound(windows: DataFrame, start: int, size: int, total: int) -> DataFrame:
    """Batch of windows (start + i) mod total, in order of i."""
    picks = windows.sparkSession.range(size).select(F.col("id").alias("i"), F.pmod(F.col("id") + start, F.lit(total)).alias("window_id"))
    return picks.join(windows, "window_id").select("i", "window_id", *[c for c in windows.columns if c != "window_id"])


def learning_rate(step: Column, total: Column, peak: float, warmup: float = 0.02, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to ``floor * peak``."""
    warm = F.greatest(F.lit(1), F.bround(total * warmup).cast("int"))
    progress = F.least(F.lit(1.0), (step - warm) / F.greatest(F.lit(1), total - warm))
    return F.when(total <= 0, 0.0).when(step < warm, peak * (step + 1) / warm).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))))


def next_round(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("round_id"), F.lit(0)) + 1).alias("round_id"))


def window_slice(windows: DataFrame, start: int, stop: int) -> DataFrame:
    return windows.where((F.col("window_id") >= start) & (F.col("window_id") < stop))
