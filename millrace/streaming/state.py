"""The cleaning pass batch by batch: what earlier batches stored decides as if all had been one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import CLEAN, CleanConfig
from millrace.functions import text as T
from millrace.functions.keys import without_keys
from millrace.functions.numbers import rounded
from millrace.functions.order import keep_top_share
from millrace.lineage import cut, drop, passing, release
from millrace.operators import dedup as D
from millrace.ship import ship

#: Folders of a stored index, by hash; a batch reads only those that its keys fall into.
SLOTS = 64
#: A shingle of the first batch is common if one in so many of its sets holds it, and at least so many; common ones come last in prefixes.
COMMON_SHARE, COMMON_LEAST = 1000, 10


class CorpusState:
    """State of an incremental cleaning pass, in tables under one shared folder.

    ``seen`` has the hash of every text that was long enough; ``sets`` and ``postings`` the shingles of those that
    are in the near-duplicate index, full and by prefix; ``documents`` what passed the guards, with its
    violations and score; ``reasons`` the counts of what was discarded, written last: a batch without them does not count.

    The index holds only rows that were kept in their turn, so what was dropped suppresses nothing.
    Candidates meet by a prefix filter in one order of shingles that the first batch fixes, and are
    verified on full sets: no pair is lost and none is taken on trust. Each table is
    split by hash into ``slots`` folders a batch, the same for the state's life, and a batch reads only folders of keys that it holds; :meth:`compact` joins the files of old batches.

    A batch reads only earlier ones and replaces its own folders, so it may be replayed. Ids must rise from batch to batch, if the
    result shall be that of one pass. Null texts count as too short; ids must not be null; an empty batch stores nothing.
    """

    def __init__(self, spark: SparkSession, root: str, holdout: DataFrame | None = None, cfg: CleanConfig = CLEAN, id_type: str = "long", slots: int = SLOTS):
        ship(spark)
        self.spark, self.root, self.holdout, self.cfg, self.slots, self.id_type = spark, root.rstrip("/"), holdout, cfg, slots, id_type
        scored = "score double, violations array<string>"
        self.schemas = {
            "seen": "hash string, batch long, slot int",
            "common": "s long, batch long, slot int",
            "sets": f"rep {id_type}, set array<long>, batch long, slot int",
            "postings": f"s long, rep {id_type}, n int, batch long, slot int",
            "documents": f"doc_id {id_type}, source string, text string, hash string, {scored}, batch long",
            "reasons": "reason string, n long, batch long",
        }

    def slot_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def read(self, name: str, before: int | None = None, slots: DataFrame | None = None) -> DataFrame:
        """A stored table, of batches before one, and only in the folders of the ``slot`` values that occur (``slots`` at most, so they pass through the driver)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schemas[name])
        out = self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")
        out = out if before is None else out.where(F.col("batch") < before)
        return out if slots is None else out.where(F.col("slot").isin([r["slot"] for r in slots.select("slot").distinct().collect()]))

    def _write(self, name: str, number: int, rows: DataFrame, key: str | None = None) -> None:
        path = f"{self.root}/{name}/batch={number}"
        if key is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            rows.withColumn("slot", self.slot_of(F.col(key))).repartition("slot").sortWithinPartitions("slot", key).write.mode("overwrite").partitionBy("slot").parquet(path)

    def prefixes(self, sets: DataFrame, before: int) -> DataFrame:
        """``id, n, s``: the shingles of each set by which similar sets must meet, in the state's order: common ones last, then by hash."""
        common = np.unique(self.read("common", before).select("s").toArrow().column("s").to_numpy().astype(np.int64))  # bounded, see :func:`D.frequent`
        return D.ordered_prefixes(sets, common, np.ones(len(common), np.int64), self.cfg.jaccard)

    def similar_to_stored(self, sets: DataFrame, prefixes: DataFrame, before: int) -> DataFrame:
        """``rep`` of the new sets that reach the threshold with a stored one, verified on both full sets."""
        # the same id may be new and stored
        new, old = (lambda c, mark=m: F.concat(F.lit(mark), F.col(c).cast("string")) for m in ("n", "o"))
        stored = self.read("postings", before, prefixes.select(self.slot_of(F.col("s")).alias("slot"))).select(old("rep").alias("b"), F.col("n").alias("nb"), "s")
        pairs = cut(D.met_pairs(prefixes.select(new("id").alias("a"), F.col("n").alias("na"), "s"), stored, self.cfg.jaccard, once=False))
        slots = pairs.select(F.expr("substring(b, 2)").cast(self.id_type).alias("rep")).select(self.slot_of(F.col("rep")).alias("slot"))
        both = sets.select(new("rep").alias("rep"), "set").union(self.read("sets", before, slots).select(old("rep").alias("rep"), "set"))
        hit = D.compared(both, pairs, self.cfg.jaccard)
        drop(pairs)
        return hit.select(F.expr("substring(a, 2)").cast(self.id_type).alias("rep")).distinct()

    def admit(self, docs: DataFrame, number: int) -> None:
        """Takes in a batch of ``docs(doc_id, source, text)``: what is new is stored with its violations and score.

        Tables that the batch needed on its way are gone when it ends, so their disk does not add up over batches. Texts are written
        twice, as what is new and as what passed the guards.
        """
        with passing(self.spark):
            self._admit(docs, number)

    def _admit(self, docs: DataFrame, number: int) -> None:
        cfg = self.cfg
        docs = docs.select("doc_id", "source", "text")
        long = D.drop_short(docs, cfg.min_chars)
        hashed = D.hashes(long)
        known = self.read("seen", number, hashed.select(self.slot_of(F.col("hash")).alias("slot"))).select("hash")
        new = D.not_in_history(D.first_of_hash(hashed), known)
        new = cut(new.select("doc_id", "hash") if self.holdout is None else D.not_in_holdout(new, self.holdout).select("doc_id", "hash"))
        other = cut(hashed.join(new, ["doc_id", "hash"], "left_anti"))
        fresh = cut(without_keys(long.withColumn("hash", T.doc_hash(F.col("text"))), ["doc_id", "hash"], other))
        release(self.spark)
        members, sets = D.shingle_classes(fresh, cfg.shingle)
        if number == 0 or self.read("common").limit(1).count() == 0 and self.read("sets", number).limit(1).count() == 0:
            self._write("common", number, D.frequent(sets, COMMON_SHARE, COMMON_LEAST).select("s"), "s")
        prefixes = cut(self.prefixes(sets, number + 1))
        hit = cut(self.similar_to_stored(sets, prefixes, number))
        met = D.prefix_pairs(prefixes, cfg.jaccard)
        for side in ("a", "b"):
            met = met.join(hit.select(F.col("rep").alias(side)), side, "left_anti")
        met = cut(met)
        release(self.spark)
        state = D.first_inserted_wins(D.compared(sets, met, cfg.jaccard))
        gone = cut(hit.union(state.where("not kept").select("id")))
        dropped = members.where("id <> rep").select(F.col("id").alias("doc_id")).union(gone.select(F.col("rep").alias("doc_id")))
        distinct = fresh.join(dropped, "doc_id", "left_anti")
        # whole texts are looked at where they lie, and the few that are found are matched by id: what is dropped need not move the others
        tainted = cut(D.tainted(fresh, self.holdout, cfg).join(dropped, "doc_id", "left_anti")) if self.holdout is not None else None
        out = dropped if tainted is None else dropped.union(tainted)
        guarded = D.judged(fresh.join(out, "doc_id", "left_anti"), cfg)

        self._write("seen", number, new.select("hash"), "hash")
        self._write("sets", number, sets.join(gone, "rep", "left_anti").select("rep", "set"), "rep")
        drop(sets)
        self._write("postings", number, prefixes.join(gone, F.col("id") == F.col("rep"), "left_anti").select("s", F.col("id").alias("rep"), "n"), "s")
        drop(prefixes)
        release(self.spark)
        self._write("documents", number, guarded.select("doc_id", "source", "text", "hash", "score", "violations"))
        guarded = self.read("documents").where(F.col("batch") == number)
        self._write("reasons", number, D.discards(docs, hashed, new, distinct.select("doc_id"), tainted, guarded))

    def done(self) -> DataFrame:
        """Batches that were stored as a whole."""
        return self.read("reasons").select("batch").distinct()

    def publish(self, texts: bool = True) -> tuple[DataFrame, DataFrame]:
        """Kept rows of all batches, with their ``texts`` or without, and ``reason, n``, as one pass over them would give: the top share is taken over all that passed."""
        stored = self.read("documents").join(F.broadcast(self.done()), "batch", "left_semi").where(F.size("violations") == 0).drop("batch")
        # texts stay where they are stored: the share is decided on ids and scores
        scores = stored.select("doc_id", "hash", "score")
        best = keep_top_share(scores, self.cfg.keep_quantile, rounded("score", 9).desc(), F.col("doc_id"), key="doc_id") if scores.limit(1).count() else scores
        best = cut(best.select("doc_id", "hash"))
        kept = cut(stored.join(best, ["doc_id", "hash"], "left_semi").select(*[c for c in stored.columns if texts or c != "text"]))  # later batches may be replayed
        reasons = self.read("reasons").groupBy("reason").agg(F.sum("n").alias("n"))
        return kept, reasons.union(D.fewer("quantile", scores, best))

    def compact(self, upto: int) -> None:
        """Joins the folders of all batches up to ``upto`` into that batch's, one file per slot; between batches only.

        The joined rows are written aside first, so a failure before the last step loses nothing; older folders are deleted when theirs is whole.
        """
        for name, key in (("seen", "hash"), ("common", "s"), ("sets", "rep"), ("postings", "s")):
            rows = cut(self.read(name, upto + 1).drop("batch", "slot"))
            self._write(name, upto, rows, key)
            for r in self.read(name, upto).select("batch").distinct().collect():  # a row per batch
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch={r['batch']}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
