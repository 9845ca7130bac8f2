"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Every unit vector is projected on PROJECTIONS random directions. On each, two vectors collide if one
lies in the window around the other; a pair is verified if it collides at least as often as a pair at
the threshold would with probability RECALL. Windows are ranges of the sorted projections whose ends
are rounded outwards to bin edges, so one bitmap per bin holds the rows inside, and the collisions of
a query with a whole block are counted bit by bit in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches, components

#: Directions, half-width of a window in standard deviations of a threshold pair's difference, and the wanted recall at the threshold.
PROJECTIONS, HALF_WIDTH, RECALL = 48, 1.15, 0.9995
#: Components of all vectors of a block, least rows of a block, queries counted at once, bins of a half-width.
BLOCK_VALUES, LEAST_BLOCK, QUERIES, BINS = 1 << 22, 1024, 64, 4
#: Least cosine of a link in the query.
COSINE = 0.9


def needed_collisions(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``: a binomial quantile."""
    p, tail = math.erf(half_width / math.sqrt(2)), 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, from vectors of one length that are sound."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # large or tiny components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def is_sound(v: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def sound(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has only finite components, not all zero."""
    return vectors.where(is_sound(F.col("embedding")))


class Projector:
    """Bins of projections for vectors of one length."""

    def __init__(self, dim: int, cosine: float, seed: int = 11):
        self.width = math.sqrt(2 - 2 * cosine) * HALF_WIDTH / BINS
        self.directions = np.random.default_rng(seed + dim).standard_normal((dim, PROJECTIONS))

    def __call__(self, units: np.ndarray) -> np.ndarray:
        return np.floor(units @ self.directions / self.width).astype(np.int32)


def window_bitmaps(bins: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per projection: the lowest bin that a query can have, and per query bin the bitmap of block rows in its window."""
    n = len(bins)
    words = -(-n // 64)
    out = []
    for column in bins.T:
        order = np.argsort(column, kind="stable")
        low, high = int(column[order[0]]) - BINS, int(column[order[-1]]) + BINS
        ranked = column[order]
        maps = np.zeros((high - low + 1, words * 64), np.bool_)
        for q in range(low, high + 1):
            lo, hi = np.searchsorted(ranked, (q - BINS, q + BINS + 1))
            maps[q - low, order[lo:hi]] = True
        out.append((low, np.packbits(maps, axis=1, bitorder="little").view(np.uint64)))
    return out


def colliding(queries: np.ndarray, windows: list[tuple[int, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, block row) that collide on at least ``least`` projections."""
    words = windows[0][1].shape[1]
    empty = np.zeros(words, np.uint64)
    for at in range(0, len(queries), QUERIES):
        part = queries[at : at + QUERIES]
        planes: list[np.ndarray] = []
        waiting: list[list[np.ndarray]] = [[]]  # bitmaps by weight, added three at a time

        def settle(weight: int, waiting=waiting) -> None:
            while len(waiting[weight]) >= 3:
                a, b, c = (waiting[weight].pop() for _ in range(3))
                if len(waiting) == weight + 1:
                    waiting.append([])
                half = a ^ b
                waiting[weight].append(half ^ c)
                waiting[weight + 1].append((a & b) | (half & c))
                settle(weight + 1)

        for (low, maps), q in zip(windows, part.T, strict=True):
            inside = (q >= low) & (q < low + len(maps))
            hit = maps[np.where(inside, q - low, 0)]
            if not inside.all():
                hit[~inside] = empty
            waiting[0].append(hit)
            settle(0)
        weight = 0
        while weight < len(waiting):
            rest = waiting[weight]
            while len(rest) > 1:
                a, b = rest.pop(), rest.pop()
                rest.append(a ^ b)
                if len(waiting) == weight + 1:
                    waiting.append([])
                waiting[weight + 1].append(a & b)
            planes.append(rest[0] if rest else np.zeros((len(part), words), np.uint64))
            weight += 1
        over, equal = np.zeros((len(part), words), np.uint64), np.full((len(part), words), ~np.uint64(0))
        for weight in range(max(len(planes), least.bit_length()) - 1, -1, -1):
            plane = planes[weight] if weight < len(planes) else np.zeros_like(over)
            if least >> weight & 1:
                equal &= plane
            else:
                over |= equal & plane
                equal &= ~plane
        row, word = np.nonzero(over | equal)
        if len(row):
            hits = np.unpackbits((over | equal)[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(hits)
            yield at + row[which], word[which] * 64 + bit


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links among n rows."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """Links at ``cosine`` or more among all rows ``(vec_id, embedding)``, whatever their other columns.

    Equal vectors are one class with a weight. Classes are dealt into blocks; each pair of blocks is
    one group of bounded size that returns, per class, its number of linked rows and a spanning link,
    never the pairs. Vectors that are null, zero, or hold null or non-finite components link with
    nothing, as do vectors of different lengths. Repeated rows count each: rows that repeat a vec_id
    keep a result of their own. An empty table gives no rows; other columns are ignored.
    Returns ``vec_id, n_links, component_id, kept``; a null vec_id has no links and is kept.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "neardup")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # floats are shuffled as floats
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    key = F.unhex(F.sha2(F.to_json(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))).cast("binary"), 256))
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & is_sound(F.col("embedding")), key))
    tagged = scratch.keep(keyed.select("vec_id", "key"))
    alike = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
    classes = scratch.keep(alike.withColumn("id", F.monotonically_increasing_id()))  # named by place in a written table: vec_ids may repeat
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    # few rows make blocks for all cores
    blocks = max(1, -(-n // max(LEAST_BLOCK, BLOCK_VALUES // dim)), min(n // LEAST_BLOCK, math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1))
    dealt = classes.select("id", "weight", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    # block b meets itself and every other block once
    sides = dealt.withColumn("pair", F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), o -> least(block, o) * {blocks} + greatest(block, o))")))
    least = needed_collisions()

    def run(key, table):
        first = key[0].as_py() // blocks
        block, ids, weight = (table.column(c).to_numpy() for c in ("block", "id", "weight"))
        lists = table.column("embedding").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        links, reach = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for dim in np.unique(lengths):
            mine = np.flatnonzero(lengths == dim)
            starts = lists.offsets.to_numpy()[mine] - lists.offsets.to_numpy()[0]
            unit = unit_rows(flat[starts[:, None] + np.arange(dim)])
            bins = Projector(int(dim), cosine)(unit)
            left = np.flatnonzero(block[mine] == first)
            right = np.flatnonzero(block[mine] != first) if len(np.unique(block)) > 1 or key[0].as_py() % blocks != first else left
            if not len(left) or not len(right):
                continue
            found = [(np.empty(0, int), np.empty(0, int))]
            for q, r in colliding(bins[left], window_bitmaps(bins[right]), least):
                q, r = left[q], right[r]
                if right is left:
                    q, r = q[q < r], r[q < r]
                for at in range(0, len(q), 20_000):
                    i, j = q[at : at + 20_000], r[at : at + 20_000]
                    ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                    i, j = mine[i[ok]], mine[j[ok]]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    found.append((i, j))
            reach = np.minimum(reach, _joined(len(ids), *(np.concatenate(x) for x in zip(*found, strict=True))))
        order = np.flatnonzero(links)
        return pa.table({"id": ids[order], "links": links[order], "to": ids[reach[order]]})

    met = scratch.keep(sides.groupBy("pair").applyInArrow(run, "id long, links long, to long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(met.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    comp = scratch.keep(comp.join(classes.select(F.col("id").alias("node"), "least"), "node"))
    comp = comp.join(comp.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("node").alias("id"), "component_id")
    found = classes.select("key", "id", "weight", "least").join(links, "id", "left").join(comp, "id", "left")
    found = found.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = tagged.where("key is not null").join(found, "key").select("vec_id", "n_links", "component_id")
    rest = tagged.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`linked_vectors` over the whole table at cosine 0.9."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
