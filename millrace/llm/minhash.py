"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Texts with equal shingle sets form one class first. Every class has TREES labels of MAX_DEPTH MinHash
values; each tree is the sorted order of its labels. Neighbours that share at least MIN_DEPTH leading
values are candidates; a region of more than DENSE neighbours is taken one value deeper, up to MAX_DEPTH.
Candidates are settled in three rounds, each confirming pairs on full sets and joining components:
every member of a region against its smallest document; then each member still apart against the most
similar signature of another component of its piece of a region; then, in regions that still hold
several components, every member outside the largest against all, block against block in large regions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import NO_ID, Scratch, bound_batches, components, extended, marked, row_keys, trim, without_keys

#: Labels (sorted orders), values that neighbours share at least and at most, and the size from which a region goes deeper.
TREES, MIN_DEPTH, MAX_DEPTH, DENSE = 20, 4, 6, 64
#: Members that are compared with each other at once; a larger region is compared block against block.
SPAN = 2048
#: Share of equal signature values from which the second round confirms a pair: over 4 standard deviations under 0.8.
LIKELY = 0.65
#: Shingles of the members that are compared at once.
WEIGHT = 1_000_000
#: Words of a shingle, and least percentage of shared shingles, of the query.
WIDTH, PERCENT = 2, 80
WORD_CACHE = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash = _WordHash()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``width``-grams; of fewer words, of the whole sequence; empty without words."""
    words = text.encode().lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    v = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    out, n = (v, 1) if len(v) < width else (v[: len(v) - width + 1], width)
    if n == 1 and width > 1:
        return np.array([xxhash.xxh3_64_intdigest(v.tobytes())], np.uint64)
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v[k : len(v) - width + 1 + k]
    return np.unique(out)


class Signer:
    """MinHash values of a shingle set: 16 bits of the smallest of its values under each random function."""

    def __init__(self, values: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, values, dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
        self.buffer = np.empty((1024, values), np.uint32)

    def __call__(self, hashes: np.ndarray) -> bytes:
        h = ((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 1024):
            part = h[at : at + 1024, None]
            buf = self.buffer[: len(part)]
            np.bitwise_xor(part, self.xor, out=buf)
            np.multiply(buf, self.odd, out=buf)
            np.minimum(low, buf.min(axis=0), out=low)
        return (low & np.uint32(0xFFFF)).astype(">u2").tobytes()


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """``did, th, n, digest, sig`` per row: its id, where null NO_ID, and the hash of its text; sig is null where the same task has given it for an equal set."""

    def run(batches):
        sign, seen = Signer(TREES * MAX_DEPTH), set()
        for b in batches:
            n, digests, sigs = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, width)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                n.append(len(s))
                digests.append(digest)
                if digest is None or digest in seen:
                    sigs.append(None)
                else:
                    if len(seen) < 200_000:
                        seen.add(digest)
                    sigs.append(sign(s))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["did", "th", "n", "digest", "sig"])
        _hash.clear()
        seen.clear()
        trim()

    return docs.select(*row_keys(), "text").mapInArrow(run, "did long, th long, n long, digest binary, sig binary")


def _regions(classes: DataFrame) -> DataFrame:
    """``region, piece, pivot, pivot_n, doc, n``: neighbours of each sorted order that share enough leading values, with their smallest document.

    A piece is a part of bounded size. Where a range begins or ends inside a stretch of equal leading
    values, that part of it also forms a region named by those values, which is the same in all ranges:
    at each depth at which the part is not dense, and at the last. So a region that ranges cut is whole again.
    """
    size = 2 * MAX_DEPTH
    labels = classes.select("doc", "n", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(sig, t * {size} + 1, {size}))")).alias("tree", "label"))
    ordered = labels.repartitionByRange("tree", "label", "doc").sortWithinPartitions("tree", "label", "doc")

    def run(batches):
        rows = [(b.column("doc").to_numpy(), b.column("n").to_numpy(), b.column("tree").to_numpy(), np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(-1, MAX_DEPTH)) for b in batches if b.num_rows]
        if not rows:
            return
        doc, weight, tree, label = (np.concatenate(x) for x in zip(*rows, strict=True))
        same = np.logical_and.accumulate(np.column_stack([tree[1:] == tree[:-1], label[1:] == label[:-1]]), axis=1).sum(axis=1) - 1  # -1: other tree
        starts = _cut(np.array([0]), len(doc), same, MIN_DEPTH)
        for depth in range(MIN_DEPTH + 1, MAX_DEPTH + 1):
            ends = np.append(starts[1:], len(doc))
            dense = ends - starts > DENSE
            deeper = [_cut(starts[i : i + 1], ends[i], same, depth) for i in np.flatnonzero(dense)]
            starts = np.sort(np.concatenate([starts[~dense], *deeper]))
        sizes = np.diff(np.append(starts, len(doc)))
        first = np.lexsort((doc, np.repeat(np.arange(len(starts)), sizes)))[starts]  # the row of each region's smallest document
        pivots, pivot_n = np.repeat(doc[first], sizes), np.repeat(weight[first], sizes)
        place = np.arange(len(doc)) - np.repeat(starts, sizes)
        heavy = np.cumsum(weight, dtype=np.int64) // WEIGHT
        heavy -= np.repeat(heavy[starts], sizes)
        own = TaskContext.get().partitionId() << 40
        region = own + np.repeat(starts, sizes)
        piece = region + np.minimum(place // SPAN + heavy, sizes.repeat(sizes) - 1)
        keep = np.repeat(sizes > 1, sizes)
        more, named = [], set()
        for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
            other = np.flatnonzero(same < depth)  # the last rows of the stretches
            for a, b in {(0, int(other[0]) + 1 if len(other) else len(doc)), (int(other[-1]) + 1 if len(other) else 0, len(doc))}:
                if b - a > DENSE and depth < MAX_DEPTH:
                    continue
                name = xxhash.xxh3_64_intdigest(bytes([tree[a], depth]) + label[a, :depth].tobytes()) >> 2 | 1 << 62
                at = np.searchsorted(starts, a, "right") - 1
                if starts[at] == a and sizes[at] == b - a and a not in named:
                    named.add(a)
                    region[a:b], keep[a:b] = name, True
                else:
                    low = a + doc[a:b].argmin()
                    parts = (1 << 39 | depth << 36 | a) + own + np.minimum(np.arange(b - a) // SPAN, b - a - 1)
                    more.append((np.full(b - a, name), parts, np.full(b - a, doc[low]), np.full(b - a, weight[low]), doc[a:b], weight[a:b]))
        out = [np.concatenate(x) for x in zip((region[keep], piece[keep], pivots[keep], pivot_n[keep], doc[keep], weight[keep]), *more, strict=True)]
        names = ["region", "piece", "pivot", "pivot_n", "doc", "n"]
        for at in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000].astype(np.int64)) for x in out], names)

    return ordered.mapInArrow(run, "region long, piece long, pivot long, pivot_n long, doc long, n long")


def _cut(start: np.ndarray, end: int, same: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the stretches of [start, end) whose neighbours share ``depth`` leading values."""
    return np.concatenate([start, start[0] + 1 + np.flatnonzero(same[start[0] : end - 1] < depth)])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets share at least ``percent`` of their union."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(doc, text):
            if doc not in kept:
                if len(kept) >= 200:
                    kept.clear()
                kept[doc] = shingles(text, width)
            return kept[doc]

        for b in batches:
            out = []
            for a, c, ta, tc in zip(*(b.column(k).to_pylist() for k in ("a", "b", "ta", "tb")), strict=True):
                x, y = of(a, ta), of(c, tc)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and 100 * shared >= percent * (len(x) + len(y) - shared):
                    out.append((a, c))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        _hash.clear()
        kept.clear()
        trim()

    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _likeliest(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``members(piece, doc, component, sig)``: for each member outside a piece's largest component, the most similar signature of another component."""

    def run(_key, table):
        doc, comp = table.column("doc").to_numpy(), table.column("component").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(doc), -1)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rest = _outside(comp)
        for at in range(0, len(rest), 64):
            i = rest[at : at + 64]
            alike = np.zeros((len(i), len(doc)), np.int32)
            for k in range(0, sig.shape[1], 20):
                alike += (sig[i, None, k : k + 20] == sig[None, :, k : k + 20]).sum(axis=2)
            alike[comp[i][:, None] == comp[None, :]] = -1
            best = alike.argmax(axis=1)
            ok = alike[np.arange(len(i)), best] >= LIKELY * sig.shape[1]
            a.append(doc[i[ok]])
            b.append(doc[best[ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return members.groupBy("piece").applyInArrow(run, "a long, b long").distinct()


def _outside(component: np.ndarray) -> np.ndarray:
    """Members outside the largest component."""
    values, counts = np.unique(component, return_counts=True)
    return np.flatnonzero(component != values[counts.argmax()])


def _blocks(members: DataFrame) -> DataFrame:
    """``region, low, high, first, doc, component`` of ``members(region, doc, n, component)``: the pairs of blocks that meet.

    A region within SPAN and WEIGHT is one block. In a larger one, members outside the largest component
    are dealt to blocks of half that size, which meet each other, and the blocks of the largest component.
    Pairs inside the largest component are joined already, so every pair that may be a link meets once.
    """
    size = F.struct("c", "component")
    of = members.groupBy("region", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("region").agg(
        F.max_by("component", size).alias("main"), F.max("c").alias("mc"), F.max_by("w", size).alias("mw"), F.sum("c").alias("c"), F.sum("w").alias("w")
    )
    whole = (F.col("c") <= SPAN) & (F.col("w") <= WEIGHT)
    parts = lambda c, w: F.greatest(F.lit(1), F.ceil(c * 2 / SPAN), F.ceil(w * 2 / WEIGHT)).cast("int")
    of = of.select("region", "main", F.when(whole, 1).otherwise(parts(F.col("c") - F.col("mc"), F.col("w") - F.col("mw"))).alias("outer"), F.when(whole, 0).otherwise(parts(F.col("mc"), F.col("mw"))).alias("inner"))
    dealt = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    outside = (F.col("component") != F.col("main")) | (F.col("inner") == 0)
    at = members.join(of, "region").withColumn("block", F.when(outside, dealt(F.col("outer"))).otherwise(F.col("outer") + dealt(F.greatest("inner", F.lit(1)))))
    met = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
    return met.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("first"), "doc", "component")


def _links_within(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components of ``members(region, low, high, first, doc, component, text)`` of two blocks, on full sets.

    Of one block, each member outside the largest component is compared with all members at once; of
    two, each of the first with all of the second. One link per component that it reaches is
    returned, so the rows never exceed members times their components.
    """

    def run(key, table):
        one = key[1].as_py() == key[2].as_py()
        if not one:
            table = table.sort_by("first")  # the second block comes before the first
        doc, comp = table.column("doc").to_numpy(), table.column("component").to_numpy().copy()
        asked = np.flatnonzero(table.column("first").to_numpy())
        n = len(doc) if one else len(doc) - len(asked)
        if not n or not len(asked):
            return pa.table({x: pa.array([], pa.int64()) for x in "ab"})
        sets = [shingles(t, width) for t in table.column("text").to_pylist()]
        _hash.clear()
        sizes = np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark, out = np.zeros(len(known), np.int64), []
        met, begin, size = flat[: sizes[:n].sum()], starts[:n], sizes[:n]
        for x in _outside(comp) if one else asked:
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[met], begin)
            mark[own] = 0
            alike = 100 * shared >= percent * (size + sizes[x] - shared)
            for c in np.unique(comp[:n][alike & (comp[:n] != comp[x])]):
                y = np.flatnonzero((comp[:n] == c) & alike)[0]
                out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
                comp[comp == c] = comp[x]
        return pa.table({n: pa.array([p[i] for p in out], pa.int64()) for i, n in enumerate("ab")})

    return members.groupBy("region", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``did, th, n, digest, lead``: per row its group's first row ``(did, th)``, those without an id last; null without shingles."""
    bound_batches(docs.sparkSession)
    base = scratch.keep(_signatures(docs, width))
    first = F.struct((F.col("did") == NO_ID).alias("none"), "did", "th")
    alike = base.where("digest is not null").groupBy("digest").agg(F.min(first).alias("lead"), F.max("sig").alias("sig"), F.max("n").cast("int").alias("n"))
    classes = scratch.keep(alike.withColumn("doc", F.monotonically_increasing_id()))  # named by place in a written table: ids may repeat
    regions = scratch.keep(_regions(classes.select("doc", "sig", "n")))
    pivot = F.min(F.struct("pivot", "pivot_n")).alias("p")
    shared = regions.where(F.col("region") >= 1 << 62).groupBy("region").agg(pivot)  # a few rows a range
    wanted = classes.join(regions.select("doc").distinct(), "doc", "left_semi").select("lead.did", "lead.th", "doc")
    some = marked(docs.select(*row_keys(), "text"), ["did", "th"], wanted).where("_maybe").drop("_maybe")
    if base.groupBy("did", "th").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        some = some.dropDuplicates(["did", "th"])  # rows that repeat an id and a text
    texts = scratch.keep(some.join(wanted, ["did", "th"]).select("doc", "text"))

    whole = regions.join(F.broadcast(shared), "region", "left").select(F.coalesce("p.pivot", "pivot").alias("a"), F.coalesce("p.pivot_n", "pivot_n").alias("na"), F.col("doc").alias("b"), "n")
    # sets of too different sizes cannot be alike; so a long text never meets a region of short ones
    tried = scratch.keep(whole.where((F.col("a") != F.col("b")) & (100 * F.least("na", "n") >= percent * F.greatest("na", "n"))).select("a", "b").distinct())
    comp = scratch.keep(components(scratch.keep(_confirmed(tried, texts, width, percent)), scratch))

    def mixed(comp: DataFrame, by: str) -> DataFrame:
        """Members of the regions, or pieces, that hold several components."""
        members = regions.select(by, "doc", "n").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        several = members.groupBy(by).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(by)
        return members.join(several, by)

    pairs = scratch.keep(_likeliest(mixed(comp, "piece").drop("n").join(classes.select("doc", "sig"), "doc")).join(tried, ["a", "b"], "left_anti"))
    comp = scratch.keep(extended(comp, scratch.keep(_confirmed(pairs, texts, width, percent)), scratch))
    last = scratch.keep(_links_within(_blocks(mixed(comp, "region")).join(texts, "doc"), width, percent))
    comp = scratch.keep(extended(comp, last, scratch))
    scratch.drop(regions, texts, tried, pairs, last)
    joined = comp.join(classes.select(F.col("doc").alias("node"), "lead"), "node")
    leads = comp.join(joined.groupBy("component").agg(F.min("lead").alias("_lead")), "component").select(F.col("node").alias("doc"), "_lead")
    of = classes.select("doc", "digest", "lead").join(leads, "doc", "left").select("digest", F.coalesce("_lead", "lead").alias("lead"))
    rows = base.select("did", "th", "n", "digest")
    # rows without a digest would all meet in one task of a join
    return rows.where("digest is not null").join(of, "digest").unionByName(rows.where("digest is null").join(of.limit(0), "digest", "left"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """Components of documents whose shingle sets overlap by at least ``percent`` of their union.

    Null and empty texts, and texts of white space, have no shingles: they link with nothing and are
    kept. Rows that repeat a doc_id are documents of their own, by their texts; a null doc_id takes part
    and is kept only where no member of its component has an id. Very long texts are taken whole. Other
    columns of ``docs`` are ignored, an empty table gives no rows.
    Returns per row ``doc_id, n_shingles, component_id, kept``.
    """
    found = _grouped(docs, width, percent, scratch or Scratch(docs.sparkSession, "minhash"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = found.select(known("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), known("did")).otherwise(known("lead.did")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of least doc_id, those without an id last, then of least text hash.

    Of rows that repeat both id and text the least by all columns stays. Texts without words are no
    duplicates of anything: such rows all stay. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    found = scratch.keep(_grouped(docs, width, percent, scratch).where("digest is not null").select("did", "th", "lead"))
    leads = (F.col("did") == F.col("lead.did")) & (F.col("th") == F.col("lead.th"))
    gone = found.where(~leads).select("did", "th").distinct()
    repeated = scratch.keep(found.where(leads).groupBy("did", "th").count().where("count > 1").select("did", "th"))
    keyed = docs.select(*row_keys(), F.struct(*docs.columns).alias("row"))
    rest = without_keys(keyed, ["did", "th"], gone.union(repeated)).select("row.*")
    if repeated.limit(1).count() == 0:
        return rest
    some = marked(keyed, ["did", "th"], repeated).where("_maybe").groupBy("did", "th").agg(F.min("row").alias("row"))
    return rest.unionByName(some.join(repeated, ["did", "th"], "left_semi").select("row.*"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` over the whole table: two-word shingles, 80 in 100."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
