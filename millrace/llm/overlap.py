"""Interval overlap join by running totals: how many intervals of a key meet another in which way, without listing the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

#: Microseconds of a break after which another session begins, and of a slot; slots looked over together when sessions are chained.
GAP, SLOT, CHAIN = 300_000_000, 86_400_000_000, 288

#: Relation of the left interval by its start (rows: earlier, equal, later) and by its end (earlier, equal, later).
RELATIONS = (("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by"))


def microseconds(ts: str) -> Column:
    """Whole microseconds of a timestamp without a zone since 1970, in no session's zone."""
    since = F.col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    whole = part("DAY").cast("long") * 86400 + part("HOUR").cast("long") * 3600 + part("MINUTE").cast("long") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def floored(value: Column, width: int) -> Column:
    """``value`` in steps of ``width``, rounded down, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def sessions(clicks: DataFrame, key: str, ts: str, last_is: Column, gap: int = GAP) -> DataFrame:
    """Sessions of each key: a time over ``gap`` after the key's previous begins another.

    Times within one cell of ``gap`` microseconds always belong together, so rows are aggregated to
    cells before anything is ordered; cells of ``CHAIN`` at a time are ordered by windows, and what a
    stretch hands on to the next is one row per key and stretch. So a key with a third of the rows is
    dealt out by time, and no task grows with the rows but only with the calendar.

    Rows with a null key or time are ignored; repeated rows and equal times are one time. A session is
    ``open`` if ``last_is`` holds for a row at its last time (null: no). Returns ``key, first, last`` (microseconds), ``open``.
    """
    rows = clicks.select(F.col(key).alias("key"), microseconds(ts).alias("t"), F.coalesce(last_is, F.lit(False)).alias("hit")).where("key IS NOT NULL AND t IS NOT NULL")
    cells = (
        rows.groupBy("key", floored(F.col("t"), gap).alias("cell"))
        .agg(F.min("t").alias("lo"), F.max(F.struct("t", "hit")).alias("hi"))
        .withColumn("stretch", floored(F.col("cell"), CHAIN))
    )
    inside = Window.partitionBy("key", "stretch").orderBy("cell")
    begins = lambda before: F.when((before.isNull()) | (F.col("lo") - before > gap), F.col("lo"))
    # the first cell of a stretch is judged by what the key's stretch before it ends with
    chained = cells.withColumn("prev", F.lag("hi.t").over(inside)).withColumn("start", F.when(F.col("prev").isNotNull(), begins(F.col("prev"))))
    of_key = Window.partitionBy("key").orderBy("stretch")
    stretches = (
        chained.groupBy("key", "stretch")
        .agg(F.min("lo").alias("lo"), F.max("hi.t").alias("end"), F.max("start").alias("inner"))
        .withColumn("head", begins(F.lag("end").over(of_key)))
        .withColumn("carried", F.last(F.coalesce("inner", "head"), ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)))
        .select("key", "stretch", F.coalesce("head", "carried").alias("head"))
    )
    started = chained.withColumn("start", F.last("start", ignorenulls=True).over(inside)).join(stretches, ["key", "stretch"])
    whole = started.groupBy("key", F.coalesce("start", "head").alias("first")).agg(F.max("hi").alias("hi"))
    return whole.select("key", "first", F.col("hi.t").alias("last"), F.col("hi.hit").alias("open"))


def relation_totals(left: DataFrame, right: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """How many ``right`` intervals of its key each ``left`` interval meets, by relation.

    ``left``: ``id, key, start, end``; ``right``: ``key, start, end, digest``; whole numbers, both ends
    inclusive, a null end is infinite. The closed intervals of a key in ``right`` must follow each other (as
    sessions do): sorted by start they are sorted by end. Then every set that a relation asks for
    is a run in that order, between two of its running totals by start or by end.

    The endpoints of ``left`` as probes and those of ``right``, closed and open apart, are united and added up by key and
    slot; windows over the slots of a key give the running counts and sums, and each left interval reads them at its start
    and at its end. Pairs are never made, so a key with a third of both sides costs one row per slot.

    Null keys and starts meet nothing, nor do intervals that end before they start; repeated rows on the left are
    answered each, on the right counted each; empty tables give no rows; other columns are ignored.
    Returns ``id, relation, n_pairs, overlap`` (shared slots, summed; null where both are infinite), ``digests`` (summed); only relations with pairs.
    """
    good = "key IS NOT NULL AND start IS NOT NULL AND (end IS NULL OR end >= start)"
    left, right = left.select("id", "key", "start", "end").where(good), right.select("key", "start", "end", "digest").where(good)
    kinds = ("by_start", "by_end", "endless")
    names = [f"{k}_{c}" for k in kinds for c in "nabc"]

    left = (scratch or Scratch(left.sparkSession, "overlap")).keep(left)  # asked twice

    # each interval once: its start, and its end if it has one
    values = {"n": "1L", "a": "start", "b": "coalesce(end, 0L)", "c": "digest"}
    points = right.selectExpr("*", "if(end IS NULL, array('endless'), array('by_start', 'by_end')) AS points").selectExpr("*", "explode(points) AS point")
    endpoints = points.selectExpr("key", "CAST(if(point = 'by_end', end, start) AS BIGINT) AS slot", *[f"CAST(if(point = '{x[:-2]}', {values[x[-1]]}, 0L) AS BIGINT) AS {x}" for x in names])
    probes = left.selectExpr("key", "explode(array_compact(array(start, end))) AS slot").selectExpr("*", *[f"0L AS {x}" for x in names])
    events = endpoints.union(probes)
    at_slots = events.groupBy("key", "slot").agg(*[F.sum(x).alias(x) for x in names])
    upto = "OVER (PARTITION BY key ORDER BY slot ROWS UNBOUNDED PRECEDING)"
    whole = "OVER (PARTITION BY key ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    running = at_slots.selectExpr("key", "slot", *[f"{x} AS own_{x}" for x in names], *[f"sum({x}) {upto} AS {x}" for x in names], *[f"sum({x}) {whole} AS all_{x}" for x in names])
    vector = lambda of: "named_struct(" + ", ".join(f"'{c}', {of(c)}" for c in "nabc") + ")"
    known = running.where("all_by_start_n + all_endless_n > 0").selectExpr(
        "key",
        "slot",
        *[f"{vector(lambda c, k=k: f'{k}_{c} - own_{k}_{c}')} AS {k}_below" for k in kinds],
        *[f"{vector(lambda c, k=k: f'{k}_{c}')} AS {k}_upto" for k in kinds],
        *[f"{vector(lambda c, k=k: f'all_{k}_{c}')} AS {k}_all" for k in ("by_start", "endless")],
    )
    here = known.withColumnRenamed("slot", "start")
    there = known.selectExpr("key", "slot AS _end", "by_start_upto AS last", "by_end_below AS ended", "by_end_upto AS ended_with", "endless_upto AS open_last")
    met = left.withColumn("_end", F.coalesce("end", "start")).join(here, ["key", "start"]).join(there, ["key", "_end"])
    at_infinity = {"last": "by_start_all", "ended": "by_start_all", "ended_with": "by_start_all", "open_last": "endless_all"}
    met = met.selectExpr(
        *["id", "start", "end", *[f"{k}_{x}" for k in kinds for x in ("below", "upto")], f"{vector(lambda c: '0L')} AS nothing"],
        *[f"if(end IS NULL, {always}, {ended}) AS {ended}" for ended, always in at_infinity.items()],
    )
    # runs (from, to] in the order of the key's intervals, by their start and by their end; a relation is where two of them meet
    starts = (("by_start_upto", "last"), ("by_start_below", "by_start_upto"), ("by_end_below", "by_start_below"))
    ends = (("ended_with", "last"), ("ended", "ended_with"), ("by_end_below", "ended"))
    open_starts = (("endless_upto", "open_last"), ("endless_below", "endless_upto"), ("nothing", "endless_below"))

    def run(i: int, j: int) -> str:
        (a, b), (c, d), (e, f) = starts[i], ends[j], open_starts[i]
        with_open = ("end IS NOT NULL", "end IS NULL", "FALSE")[j]
        closed_run = f"'lo', if({a}.n >= {c}.n, {a}, {c}), 'hi', if({b}.n <= {d}.n, {b}, {d})"
        return f"named_struct('relation', '{RELATIONS[i][j]}', 'i', {i}, 'j', {j}, {closed_run}, 'open_lo', {e}, 'open_hi', if({with_open}, {f}, {e}))"

    runs = met.selectExpr("id", "start", "end", f"inline(array({', '.join(run(i, j) for i in range(3) for j in range(3))}))")
    less = lambda hi, lo: vector(lambda c: f"if({hi}.n > {lo}.n, {hi}.{c} - {lo}.{c}, 0L)")
    found = runs.selectExpr("id", "start", "end", "relation", "i", "j", f"{less('hi', 'lo')} AS x", f"{less('open_hi', 'open_lo')} AS y").where("x.n + y.n > 0")
    least_ends, latest_starts = "if(j = 2, x.b, (x.n + y.n) * end)", "if(i = 0, x.a + y.a, (x.n + y.n) * start)"  # no end: both are infinite
    return found.selectExpr("id", "relation", "x.n + y.n AS n_pairs", f"{least_ends} - {latest_starts} + x.n + y.n AS overlap", "x.c + y.c AS digests")


def op11_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`relation_totals` of all sales and the click sessions of their clients, in slots of 24 hours.

    A sale ends with the last shipping of its lines, if that is after it; held sales and sessions that end with a click are open.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = sessions(read("clicks"), "client_id", "ts", F.col("kind") == "click")
    shipped = read("sale_lines").where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max("shipped_at").alias("shipped_at"))
    sales = read("sales").select("sale_id", "client_id", "status", "sold_at").join(shipped, "sale_id", "left").withColumn("until", F.greatest("sold_at", "shipped_at"))
    slot = lambda t: floored(t, SLOT)
    left = sales.select(
        F.col("sale_id").alias("id"),
        F.col("client_id").alias("key"),
        slot(microseconds("sold_at")).alias("start"),
        F.when(F.coalesce(F.col("status") == "held", F.lit(False)), F.lit(None)).otherwise(slot(microseconds("until"))).alias("end"),
    )
    right = found.select("key", slot(F.col("first")).alias("start"), F.when(~F.col("open"), slot(F.col("last"))).alias("end"), F.crc32(F.col("first").cast("string").cast("binary")).alias("digest"))
    return relation_totals(left, right).select(F.col("id").alias("sale_id"), "relation", "n_pairs", F.col("overlap").alias("overlap_slots"), F.col("digests").alias("sessions_crc"))
