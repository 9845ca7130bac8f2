"""Approximate nearest neighbours by cosine: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches
from millrace.llm.neardup import sound, unit_rows

#: Vectors that fit the index: this many or SAMPLED_BY_LIST for each list (bounded sample), most lists, codes per subspace and dimensions of a subspace.
SAMPLE, SAMPLED_BY_LIST, MAX_LISTS, CODES, SUBSPACE = 20_000, 16, 8192, 256, 4
#: Share of sampled neighbours whose list is probed, sampled queries for that, classes of density that each must reach the share.
COVERAGE, CALIBRATION, DENSITIES = 0.96, 400, 4
#: Candidates of a block scored exactly at first.
RERANKED = 64
#: Components of all vectors of a block of a list, and of a block of queries that visit a list.
LIST_VALUES, QUERY_VALUES = 1 << 19, 1 << 21
#: Entries of a matrix of rows by lists that is held at once.
CELLS = 1 << 22
#: Allowance for the single precision of estimates.
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's iterations; an emptied centre is put on a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[filled]
        centres[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled, None]
        for empty in np.flatnonzero(counts == 0):
            centres[empty] = x[rng.integers(len(x))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, step = (centres * centres).sum(axis=1) / 2, max(64, CELLS // len(centres))
    return np.concatenate([(x[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    """Coarse centres, codebooks of the residuals by subspace, and the number of lists to probe."""

    centres: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]
    probes: int

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, k: int, seed: int = 5) -> Index:
        """From unit vectors of a sample. Probes are calibrated on the sample's own neighbours, for dense and sparse places apart."""
        x = units.astype(np.float32)
        lists = max(1, min(lists, len(x)))
        centres = k_means(x, lists, 8, seed)
        at = nearest(x, centres)
        residuals = (x - centres[at])[:10_000]
        spans = [(i, min(i + SUBSPACE, x.shape[1])) for i in range(0, x.shape[1], SUBSPACE)]
        books = [k_means(residuals[:, a:b], CODES, 6, seed + a) for a, b in spans]
        asked = np.random.default_rng(seed).choice(len(x), min(CALIBRATION, len(x)), replace=False)
        alike = x[asked] @ x.T
        alike[np.arange(len(asked)), asked] = -2
        top = np.argsort(-alike, axis=1)[:, : min(k, max(1, len(x) - 1))]
        order = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)
        ranks = np.take_along_axis(order, at[top], axis=1)
        by_density = np.argsort(np.take_along_axis(alike, top[:, -1:], axis=1)[:, 0], kind="stable")
        probes = max(int(np.quantile(ranks[part], COVERAGE, method="higher")) + 1 for part in np.array_split(by_density, DENSITIES) if len(part))
        return cls(centres, books, spans, min(lists, probes))

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the distance of each row to what its codes say: no estimate for a unit query is farther off."""
        x = units.astype(np.float32)
        at = nearest(x, self.centres)
        residuals = x - self.centres[at]
        codes = np.column_stack([nearest(residuals[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)]).astype(np.uint8)
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            residuals[:, a:b] -= book[codes[:, m]]
        return at, codes, np.sqrt((residuals * residuals).sum(axis=1))

    def estimates(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: dot products of whole queries with quantised rows of one list."""
        q = queries.astype(np.float32)
        out = np.repeat((q @ self.centres[at])[:, None], len(codes), axis=1)
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            out += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return out


def _matrix(column) -> np.ndarray:
    """Vectors of a column as rows, in double precision."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 1))


def _nearest_of_block(index: Index, at: int, k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The ``k`` nearest, by different ids, of a block of a list for each query that visits it."""
    out = [[], [], []]
    if left.num_rows and right.num_rows:
        left = left.sort_by("vec_id")  # equal estimates go to the smaller id
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("embedding"))
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        off = left.column("off").to_numpy() + SLACK
        again = np.append(False, (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(axis=1))
        if again.any():  # equal rows are one candidate
            ids, x, codes, off = ids[~again], x[~again], codes[~again], off[~again]
        depth = k * int(np.unique(ids, return_counts=True)[1].max())  # other rows of an id may come before the k-th id
        asked, q = right.column("query_id").to_numpy(), _matrix(right.column("query"))
        norms = np.sqrt((x * x).sum(axis=1))
        unit, rows = unit_rows(list(q)), unit_rows(list(x))
        for start in range(0, len(q), 64):
            guess = index.estimates(unit[start : start + 64], at, codes)
            guess[asked[start : start + 64, None] == ids[None, :]] = -np.inf
            first = np.argpartition(-guess, min(RERANKED + depth, len(ids)) - 1, axis=1)[:, : RERANKED + depth]
            for i, chosen in enumerate(first):
                own, vector = asked[start + i], q[start + i]
                chosen = chosen[ids[chosen] != own]
                if len(chosen) > depth:
                    sure = np.partition(rows[chosen] @ unit[start + i], -depth)[-depth]
                    chosen = np.flatnonzero(guess[i] + off >= sure)
                    alike = rows[chosen] @ unit[start + i]
                    chosen = chosen[alike >= np.partition(alike, -depth)[-depth] - SLACK]  # near ties go on to the last digit
                score = x[chosen] @ vector / (norms[chosen] * np.sqrt(vector @ vector))
                best = np.lexsort((ids[chosen], -score))
                best = best[np.sort(np.unique(ids[chosen][best], return_index=True)[1])[:k]]  # the best row of each id
                out[0].append(np.full(len(best), own))
                out[1].append(ids[chosen][best])
                out[2].append(score[best])
    return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest found of all rows of ``vectors`` for each row of ``queries`` (both ``vec_id, embedding``), by cosine.

    The index is fitted on a bounded sample; every row is indexed. Each query visits its nearest lists,
    more where those hold too few rows, and all where it still finds fewer than ``k``. In each block of
    a list (bounded, so a crowded list makes more blocks) candidates are ordered by distance tables,
    the best are scored exactly, and then all whose estimate lies within their quantisation error of
    the k-th exact score, so nothing nearer is lost in a visited list. Rows with a query's own id are
    no candidates; other rows that repeat an id are one candidate, at the best score. Queries that repeat
    an id are one query; if their vectors differ, a candidate's score is its best with any of them. Ties go to the smaller id; with fewer candidates all are
    returned. Vectors that are null, zero, hold null or non-finite components, have a null id, or
    differ in length from the most frequent length take no part; an empty table gives no rows. Other
    columns are ignored. Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "ann")
    floats = all(dict(t.dtypes)["embedding"] == "array<float>" for t in (vectors, queries))
    kind = "array<float>" if floats else "array<double>"  # floats are shuffled as floats
    cols = [F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding")]
    rows, asked = (sound(t.select(*cols).where("vec_id is not null")) for t in (vectors, queries))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]["d"], lengths[0]["count"]
    rows, asked = rows.where(F.size("embedding") == dim), asked.where(F.size("embedding") == dim)
    wanted_lists = max(1, min(MAX_LISTS, int(n**0.5)))
    most = max(SAMPLE, SAMPLED_BY_LIST * wanted_lists)
    share = int(min(1.0, 0.9 * most / n) * (1 << 31))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 31)) < share).select("embedding").limit(most).toArrow()
    units = unit_rows(list(_matrix(sample.column("embedding")))) if sample.num_rows else np.eye(1, dim)
    index = Index.fit(units, wanted_lists, k)
    held = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centres and CODES codes

    def encode(batches):
        for b in batches:
            if b.num_rows:
                at, codes, off = held.value.encode(unit_rows(list(_matrix(b.column("embedding")))))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off.astype(np.float32)), b.column("embedding")], ["list", "vec_id", "codes", "off", "embedding"])

    coded = rows.select("vec_id", "embedding").mapInArrow(encode, f"list int, vec_id long, codes binary, off float, embedding {kind}")
    coded = scratch.keep(coded.withColumn("place", F.monotonically_increasing_id()))
    sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # a row per list
    asked = scratch.keep(asked.dropDuplicates(["vec_id", "embedding"]))
    in_parts = lambda counts, values: F.create_map(*[F.lit(x) for at, c in sorted(counts.items()) for x in (at, -(-c * dim // values))])
    held_sizes = np.array([sizes.get(at, 0) for at in range(len(index.centres))])

    def found(asked: DataFrame, everywhere: bool) -> DataFrame:
        def probe(batches):
            index = held.value
            step = max(1, CELLS // len(index.centres))
            for whole in batches:
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    order = np.argsort(-(unit_rows(list(_matrix(b.column("embedding")))) @ index.centres.T), axis=1, kind="stable")
                    enough = (np.cumsum(held_sizes[order], axis=1) <= k).sum(axis=1) + 1  # lists that hold k rows and the query's own
                    many = np.full(b.num_rows, len(index.centres)) if everywhere else np.maximum(index.probes, enough)
                    visited = (np.arange(len(index.centres)) < many[:, None]) & (held_sizes[order] > 0)
                    which, lists = np.nonzero(visited)[0], order[visited].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(lists), b.column("vec_id").take(pa.array(which)), b.column("embedding").take(pa.array(which))], ["list", "query_id", "query"])

        visits = scratch.keep(asked.select("vec_id", "embedding").mapInArrow(probe, f"list int, query_id long, query {kind}"))
        counts = {r["list"]: r["count"] for r in visits.groupBy("list").count().collect()}
        if not counts:
            return spark.createDataFrame([], schema)
        parts, q_parts = in_parts({at: sizes[at] for at in counts}, LIST_VALUES)[F.col("list")], in_parts(counts, QUERY_VALUES)[F.col("list")]
        # each block of a list meets each block of the queries that visit it
        blocks = coded.where(F.col("list").isin(list(counts))).withColumn("block", F.pmod(F.xxhash64("place"), parts).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), q_parts - 1)))
        visits = visits.withColumn("q_block", F.pmod(F.xxhash64("query_id", "query"), q_parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
        by = ["list", "block", "q_block"]
        near = blocks.drop("place").groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(lambda key, left, right: _nearest_of_block(held.value, key[0].as_py(), k, left, right), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return scratch.keep(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    out = found(asked, index.probes >= len(index.centres))
    if index.probes < len(index.centres):
        full = out.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k)
        short = scratch.keep(asked.join(full, "vec_id", "left_anti"))
        if short.limit(1).count():
            ids = short.select(F.col("vec_id").alias("query_id")).distinct()
            out = out.join(ids, "query_id", "left_anti").unionByName(found(short, True))
    return out


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`search` over the whole table; queries are the rows whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
