"""Crawl planning and its audit; the fetching itself is an interface, since an engine on a cluster reads what a crawler stored."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.functions.numbers import rounded
from millrace.functions.text import url_domain, url_key


def sampled_ids(spark: SparkSession, first: int, last: int, n: int, seed: int) -> DataFrame:
    """``n`` distinct ids by seeded hash."""
    return spark.range(first, last + 1).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def shuffled(urls: DataFrame, seed: int, url: str = "url") -> DataFrame:
    """Seeded order of discovered URLs."""
    return urls.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(url)).cast("binary")), url)


def allowed(urls: DataFrame, rules: DataFrame, robots: DataFrame | None = None, url: str = "url") -> DataFrame:
    """URLs that robots rules ``(host, prefix, allow)`` permit: the longest matching prefix decides, none permits.

    ``robots(host, status)``: 401 and 403 deny a host, anything else but 200 permits it.
    """
    u = urls.withColumn("_host", url_domain(F.col(url))).withColumn("_path", F.coalesce(F.parse_url(F.col(url), F.lit("PATH")), F.lit("/")))
    hit = u.join(rules, u["_host"] == rules["host"]).where(F.col("_path").startswith(F.col("prefix")))
    verdict = hit.groupBy(url).agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow"))).alias("_allow"))
    out = u.join(verdict, url, "left")
    permit = F.coalesce("_allow", F.lit(True))
    if robots is not None:
        out = out.join(robots.select(F.col("host").alias("_host"), "status"), "_host", "left")
        permit = F.when(F.col("status").isin(401, 403), False).when(F.col("status").isNull() | (F.col("status") == 200), permit).otherwise(True)
    return out.where(permit).select(*urls.columns)


def rate_audit(log: DataFrame, rps: float, domain: str, ts: Column) -> DataFrame:
    """Requests that came sooner after the previous one of their domain than the rate allows: by domain, with the least gap."""
    if rps <= 0:
        raise ValueError("rate must be positive")
    t = log.select(F.col(domain).alias("domain"), ts.alias("t"))
    gaps = t.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("domain").orderBy("t")))
    return gaps.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(F.col("gap") < 1 / rps).alias("too_soon"), rounded(F.min("gap"), 6).alias("min_gap"))


# Seconds before the second, third and later attempts, and answers that end them at once.
BACKOFFS, BLOCKED = (2.0, 4.0, 8.0), (403, 429)
LOG = "source string, url string, status int, bytes long, ts double, note string, content binary"


def fetch(url: str, get: Callable[[str], tuple[int, bytes]], retries: int = 3, wait: Callable[[], None] = lambda: None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Iterator[tuple]:
    """``(status, bytes, ts, note, content)`` of every attempt; only a success, the last one, has content.

    ``get`` gives status and content, or raises OSError. ``wait`` keeps the rate before each attempt;
    between attempts the pause doubles; a blocked or rate-limited answer ends them.
    """
    attempts = max(1, retries)
    for attempt in range(attempts):
        wait()
        try:
            status, content = get(url)
        except OSError as e:
            yield -1, 0, clock(), f"error:{type(e).__name__}", None
        else:
            if status == 200 and content:
                yield status, len(content), clock(), None, content
                return
            yield status, len(content or b""), clock(), None, None
            if status in BLOCKED:
                return
        if attempt < attempts - 1:
            sleep(BACKOFFS[min(attempt, len(BACKOFFS) - 1)])


def crawl(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], rps: float, retries: int = 3, rules: DataFrame | None = None, robots: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One pass over ``urls(source, url)``: the log of all attempts, with the content of successes (see LOG).

    Hosts are fetched beside each other, each in one task that keeps its rate. URLs that robots rules
    forbid are logged with status -1 and not fetched. ``get`` runs on the executors.
    """
    if rps <= 0:
        raise ValueError("rate must be positive")
    permitted = urls if rules is None else allowed(urls, rules, robots)
    denied = urls.join(permitted.select("url").distinct(), "url", "left_anti")
    skipped = denied.select("source", "url", F.lit(-1).alias("status"), F.lit(0).cast("long").alias("bytes"), (F.unix_micros(F.current_timestamp()) / 1e6).alias("ts"), F.lit("robots_disallowed").alias("note"), F.lit(None).cast("binary").alias("content"))

    def host(pdf):
        rows, last = [], [None]

        def wait():
            now = time.time()
            if last[0] is not None and now - last[0] < 1 / rps:
                sleep(1 / rps - (now - last[0]))
            last[0] = time.time()

        for source, url in zip(pdf["source"], pdf["url"], strict=True):
            rows += [(source, url, *r) for r in fetch(url, get, retries, wait, sleep)]
        return pd.DataFrame(rows, columns=["source", "url", "status", "bytes", "ts", "note", "content"])

    done = permitted.select("source", "url").groupBy(url_domain(F.col("url"))).applyInPandas(host, LOG)
    return done.unionByName(skipped)


def pages(log: DataFrame, root: str = "") -> DataFrame:
    """Successes of a pass in the shape that raw files are read in: ``path, modificationTime, length, content``, a path per domain and URL key. The log itself, as a table, is the store."""
    path = F.concat(F.lit(f"{root}/" if root else ""), url_domain(F.col("url")), F.lit("/"), url_key(F.col("url")), F.lit(".raw"))
    return log.where("status = 200").select(path.alias("path"), F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("modificationTime"), F.col("bytes").alias("length"), "content")


class PagedSource(DataSource):
    """Source over a paging API, for a batch or a stream; ``register`` gives it the function that fetches one page.

    Options: ``count`` of items, ``batch`` of items per page, and for streams ``pages`` per micro-batch.
    """

    fetch: Callable[[int, int], list[tuple]] | None = None

    @classmethod
    def name(cls) -> str:
        return "millrace_paged"

    def schema(self) -> str:
        return "source string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("count", 0)), int(self.options.get("batch", 20)))


    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagedStream(type(self).fetch, int(self.options.get("count", 0)), int(self.options.get("batch", 20)), int(self.options.get("pages", 8)))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, count: int, batch: int):
        self.fetch, self.count, self.batch = fetch, count, batch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.count, self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.fetch is None:
            raise RuntimeError("no fetch function is registered")
        try:
            yield from self.fetch(partition.value, min(self.batch, self.count - partition.value))
        except OSError as e:
            logging.getLogger(__name__).warning("page at %s failed, its batch ends: %s", partition.value, e)


class _PagedStream(DataSourceStreamReader):
    """Pages of a micro-batch are partitions, fetched on the executors; the offset counts items. A restarted stream is told where it was by an empty range.

    Offsets are in the query's checkpoint, so a stream that was stopped goes on after its last finished batch, and one that failed
    fetches the pages of the unfinished batch again. A page that fails, fails its task and is tried anew as tasks are: it is never passed over.
    """

    def __init__(self, fetch, count: int, batch: int, pages: int):
        self.fetch, self.count, self.batch, self.pages = fetch, count, batch, pages
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"item": 0}

    def latestOffset(self) -> dict:
        """One micro-batch on from where the stream is; the end once it is reached."""
        at = 0 if self.at is None else self.at
        return {"item": min(self.count, at + self.pages * self.batch)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["item"]
        return [InputPartition((i, min(self.batch, end["item"] - i))) for i in range(start["item"], end["item"], self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.fetch is None:
            raise RuntimeError("no fetch function is registered")
        yield from self.fetch(*partition.value)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["item"])


def register(spark: SparkSession, fetch: Callable[[int, int], list[tuple]]) -> None:
    spark.dataSource.register(type("Paged", (PagedSource,), {"fetch": staticmethod(fetch)}))
