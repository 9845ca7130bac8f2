"""Directed is_a graph: construction, cycle and triangle census, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import GRAPH, GraphConfig
from millrace.lineage import cut


def build(triplets: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """``u, v, conf, triplet_id``: sure facts of the relation (a missing one counts), the best per edge, among the nodes of largest degree.

    Ties of an edge go to the smaller id, of a degree to the smaller name; a self-loop counts twice.
    """
    sure = triplets.where((F.coalesce("rel", F.lit(cfg.relation)) == cfg.relation) & (F.col("conf") >= cfg.min_conf))
    best = sure.groupBy(F.col("sub").alias("u"), F.col("obj").alias("v")).agg(F.min_by(F.struct("conf", "triplet_id"), F.struct(-F.col("conf"), F.col("triplet_id"))).alias("b"))
    edges = best.select("u", "v", "b.conf", "b.triplet_id")
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    top = degree.orderBy(F.desc("d"), "node").limit(cfg.top_nodes).select("node")
    return edges.join(F.broadcast(top.withColumnRenamed("node", "u")), "u", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "v")), "v", "left_semi").select("u", "v", "conf", "triplet_id")


def _steps(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of two nodes from their smaller one, the steps that a path may take, and the edges that close one."""
    e = edges.where("u <> v").select("u", "v", "conf")
    paths = e.where("u < v").select(F.col("u").alias("s"), F.col("v").alias("t"), F.array("u", "v").alias("path"), "conf")
    step, back = e.select(F.col("u").alias("t"), F.col("v").alias("n"), F.col("conf").alias("c")), e.select(F.col("u").alias("t"), F.col("v").alias("s"), F.col("conf").alias("c"))
    return paths, step, back


def _closed(paths: DataFrame, back: DataFrame) -> DataFrame:
    return paths.join(back, ["t", "s"]).select("path", F.least("conf", "c").alias("min_conf"))


def _grown(paths: DataFrame, step: DataFrame) -> DataFrame:
    longer = paths.join(step, "t").where((F.col("n") > F.col("s")) & ~F.array_contains("path", F.col("n")))
    return longer.select("s", F.col("n").alias("t"), F.concat("path", F.array("n")).alias("path"), F.least("conf", "c").alias("conf"))


def cycles(edges: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """``path, min_conf`` of the simple directed cycles of 2 to max_len nodes, each from its smallest node.

    Paths grow one join at a time and only through larger nodes, so each cycle is met once.
    """
    paths, step, back = _steps(edges)
    found = []
    for length in range(2, cfg.max_len + 1):
        found.append(_closed(paths, back))
        if length < cfg.max_len:
            paths = _grown(paths, step)
    return reduce(DataFrame.unionByName, found)


def census(edges: DataFrame, cfg: GraphConfig = GRAPH) -> DataFrame:
    """One row: cycles counted up to the cap, whether it or the bound of work was reached, and the first 50 for an audit.

    Before paths grow, the edges that they would try are counted; where that exceeds ``max_work`` in
    all, longer cycles are not looked for, so the count is a floor and ``truncated`` says so.
    """
    edges = cut(edges)
    paths, step, back = _steps(edges)
    degree = cut(step.groupBy("t").agg(F.count("*").alias("d")))
    found, work, stopped = [], edges.count(), False
    for length in range(2, cfg.max_len + 1):
        work += paths.join(degree, "t").agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
        stopped = work > cfg.max_work
        if stopped and length > 2:
            break
        found.append(_closed(paths, back))
        if stopped or length == cfg.max_len:
            break
        paths = cut(_grown(paths, step))
    listed = reduce(DataFrame.unionByName, found).orderBy(F.size("path"), "path", F.desc("min_conf")).limit(cfg.max_cycles)
    sample = F.slice(F.array_sort(F.collect_list(F.struct(F.size("path").alias("n"), "path", "min_conf"))), 1, 50)
    return listed.agg(F.count("*").alias("count"), (F.lit(stopped) | (F.count("*") >= cfg.max_cycles)).alias("truncated"), sample.alias("sample"))


def triangles(edges: DataFrame, exclude_self_loops: bool = False) -> DataFrame:
    """Closed walks of three steps, over 3: those through self-loops count unless excluded."""
    e = edges.select("u", "v").distinct()
    if exclude_self_loops:
        e = e.where("u <> v")
    two = e.select(F.col("u").alias("a"), F.col("v").alias("b")).join(e.select(F.col("u").alias("b"), F.col("v").alias("c")), "b")
    walks = two.join(e.select(F.col("u").alias("c"), F.col("v").alias("a")), ["c", "a"])
    return walks.agg(F.floor(F.count("*") / 3).cast("long").alias("triangles"))


def distances(edges: DataFrame) -> DataFrame:
    """``a, b, distance`` of unordered pairs below 1: one minus the larger confidence of both directions."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg((1 - F.max("conf")).alias("distance")).where("distance < 1")
