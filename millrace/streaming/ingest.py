"""Incremental ingest: micro-batches of new raw files, deduplicated against what earlier batches stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import CLEAN, CleanConfig
from millrace.functions import text as T
from millrace.ship import ship
from millrace.streaming.state import CorpusState

RAW = "path string, modificationTime timestamp, length long, content binary"


def raw_stream(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", "*.raw").option("recursiveFileLookup", "true").load(root)


def prepared(raw: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    """``doc_id, path, source, text``: extracted, normalized, unwrapped and chunked; the id is the path and the chunk's number, so it orders as they do."""
    ship(raw.sparkSession)
    html = F.make_valid_utf8(F.col("content").cast("string"))
    main = F.when(html.contains("<"), T.extract_main(html)).otherwise(F.when(~T.is_challenge(html), T.strip_boilerplate(html)))
    parts = T.chunks(T.unwrap(T.normalize(main)), cfg.max_chars)
    folder = F.element_at(F.split("path", "/"), -2)
    alias = F.create_map(*[F.lit(x) for kv in cfg.source_alias.items() for x in kv]) if cfg.source_alias else None
    source = folder if alias is None else F.coalesce(F.try_element_at(alias, folder), folder)  # rules by source apply to crawled domains
    out = raw.select("path", source.alias("source"), F.posexplode(parts).alias("_part", "text"))
    return out.select(F.concat("path", F.lit("#"), F.lpad(F.col("_part").cast("string"), 8, "0")).alias("doc_id"), "path", "source", "text")


def ingest(raw: DataFrame, store: str, checkpoint: str, cfg: CleanConfig = CLEAN, holdout: DataFrame | None = None) -> StreamingQuery:
    """Runs the cleaning pass over new files, batch by batch, until no input is left; :class:`CorpusState` in ``store`` holds what it knows.

    Exact and near copies of anything that an earlier batch put into the index are dropped, texts of the holdout too, and
    ``CorpusState.publish`` gives the kept rows of all batches so far. State lives in the tables, not in the
    stream's memory. A batch that is replayed after a failure replaces its own folders.
    """
    state = CorpusState(raw.sparkSession, store, holdout, cfg, "string")
    return prepared(raw, cfg).writeStream.foreachBatch(lambda df, number: state.admit(df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within(query: StreamingQuery, seconds: float) -> bool:
    """Waits for a query as long as a round's wall-clock budget allows, then stops it; whether it had finished. The next round goes on from its checkpoint."""
    try:
        return bool(query.awaitTermination(seconds))
    finally:
        query.stop()


def unique_stream(docs: DataFrame, key: str = "hash") -> DataFrame:
    """Stateful exact deduplication of a stream; its state grows with the stream, so prefer :func:`ingest` for long ones."""
    return docs.dropDuplicates([key])


def fresh(raw: DataFrame, since) -> DataFrame:
    """Files changed at or after a time."""
    return raw.where(F.col("modificationTime") >= F.lit(since))
