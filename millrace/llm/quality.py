"""Document quality: a ridge fit on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches, marked, trim
from millrace.llm.language import fold

#: Random features, width of the Gaussian kernel over standardised statistics, ridge weight, bins of scores for calibration.
FEATURES, GAMMA, RIDGE, SCORE_BINS = 384, 0.03, 1.0, 4096
#: Statistics are clipped to so many standard deviations.
CLIP = 4.0
#: Score from which a document is predicted to be good.
CUT = 0.3

_word = regex.compile(r"\p{L}+")
_digits = bytes(range(48, 58))
_upper = bytes(range(65, 91))
_lower = bytes(range(97, 123))
_space = b" \t\n\r\x0b\x0c"
_plain = b".,;:!?'\"()-"
NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "plain_punct", "symbol", "wide",
    "distinct_words", "top_word", "distinct_lines", "log_lines", "words_per_line", "end_stop", "repeat", "letters_only", "capital_words",
)


def statistics(text: str | None) -> list[float]:
    """Shares and sizes of a whole text; all are finite, also for an empty one."""
    raw = (text or "").encode()
    n = len(raw) or 1
    words = raw.split()
    m = len(words) or 1
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    left = lambda drop: len(raw.translate(None, drop))
    upper, lower, digit, space, plain = (len(raw) - left(x) for x in (_upper, _lower, _digits, _space, _plain))
    wide = len(raw) - len(raw.translate(None, bytes(range(128, 256))))
    symbol = len(raw) - upper - lower - digit - space - plain - wide
    tidy = sum(w.rstrip(b".,").isalpha() if w.isascii() else w.rstrip(b".,").decode().isalpha() for w in counts)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(60.0, (n - space) / m), upper / n, digit / n, space / n, plain / n, symbol / n, wide / n,
        len(counts) / m * np.log1p(m), max(counts.values(), default=0) / m, len(set(lines)) / (len(lines) or 1), np.log1p(len(lines)), np.log1p(m / (len(lines) or 1)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / (len(lines) or 1), len(zlib.compress(raw, 1)) / n if raw else 1.0, tidy / (len(counts) or 1), sum(w[:1].isupper() for w in words) / m,
    ]


@dataclass
class Quality:
    """Standardisation, random features, weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(17)
        omega = rng.standard_normal((x.shape[1], FEATURES)) * np.sqrt(2 * GAMMA)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ omega + phase), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; 0.5 where nothing was learned."""
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(at: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit to binned outcomes: pooled adjacent violators, means of pools joined by lines."""
    pools: list[list[float]] = []  # [positives, count, position * count]
    for p, c, x in zip(positives, counts, at, strict=True):
        pools.append([p, c, x * c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5 * 1e-3) / (p[1] + 1e-3) for p in pools])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(batch.num_rows, len(NAMES))


def _summed(parts: DataFrame, columns: int) -> np.ndarray:
    """Sum of equal-sized vectors, one per task: added in 16 tasks, then on the driver."""

    def add(batches):
        total = np.zeros(columns)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum((np.frombuffer(r["v"]) for r in parts.coalesce(16).mapInArrow(add, "v binary").collect()), np.zeros(columns))


def _fit(labelled: DataFrame, scratch: Scratch) -> Quality:
    """From ``labelled(stats, y, part)``: rows of part 0 calibrate, the others fit; where either has none, all rows do."""
    d = len(NAMES)

    def moments(batches):
        total = np.zeros(2 * d + 1)
        for b in batches:
            x = _rows(b)
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    m = _summed(labelled.select("stats").mapInArrow(moments, "v binary"), 2 * d + 1)
    n = m[-1]
    if not n:
        return Quality(np.zeros(d), np.ones(d))
    mean = m[:d] / n
    model = Quality(mean, np.sqrt(np.maximum(m[d : 2 * d] / n - mean**2, 1e-12)))
    f = FEATURES + 1

    def normal(batches):
        gram = np.zeros((f, f + 1))
        for b in batches:
            z = model.features(_rows(b))
            gram += z.T @ np.column_stack([z, b.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], ["v"])

    def outcomes(condition: str) -> list:
        some = labelled.where(condition).select("stats", "y").mapInArrow(binned, "bin int, y double")
        return some.groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()

    fits = "part <> 0" if labelled.where("part <> 0").limit(1).count() else "true"
    parts = scratch.keep(labelled.where(fits).select("stats", "y").mapInArrow(normal, "v binary"))
    gram = _summed(parts, f * (f + 1)).reshape(f, f + 1)
    scratch.drop(parts)
    penalty = RIDGE * np.eye(f)
    penalty[-1, -1] = 1e-6  # the constant is free
    model.weights = np.linalg.solve(gram[:, :f] + penalty, gram[:, f])

    def binned(batches):
        for b in batches:
            at = np.clip(((model.raw(_rows(b)) + 1) / 3 * SCORE_BINS).astype(np.int32), 0, SCORE_BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("y")], ["bin", "y"])

    bins = outcomes("part = 0") or outcomes("true")
    if bins:
        at = (np.array([r["bin"] for r in bins]) + 0.5) / SCORE_BINS * 3 - 1
        model.knots = isotonic(at, np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return model


def _measured(docs: DataFrame, columns: str) -> DataFrame:
    """``columns`` (names and types) of ``docs``, as they are, and the ``stats`` of each text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def measure(batches):
        for b in batches:
            stats = [np.array(statistics(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(stats, pa.binary())], [*names, "stats"])
        trim()

    return docs.mapInArrow(measure, f"{columns}, stats binary")


def _known(labels: DataFrame) -> DataFrame:
    """One label ``doc_id, y`` an id."""
    return labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))


def assess(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Quality of every whole text of ``docs(doc_id, text)``, learned from ``labels(doc_id, quality)``.

    Texts are read once, for their statistics; labels meet those. Normal equations and moments are
    summed by task. A quarter of the labelled rows, by hash of the id, calibrates and does not fit (all
    do both where that quarter is empty). Null and empty texts have the statistics of an empty text and
    get a score like any other; null labels teach nothing and of repeated labels the larger counts;
    without labels each score is 0.5. Repeated rows are judged each; an empty table gives no rows.
    Other columns are ignored. Returns ``doc_id, score, predicted``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "quality")
    measured = scratch.keep(_measured(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long"))
    labelled = scratch.keep(measured.join(_known(labels), "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("part")))
    model = spark.sparkContext.broadcast(_fit(labelled, scratch))
    scratch.drop(labelled)

    def judge(batches):
        for b in batches:
            score = model.value.score(_rows(b)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return measured.mapInArrow(judge, "doc_id long, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` whose texts are predicted to be good, with all their columns; learned like :func:`assess`.

    The labelled texts are measured first; then each row is judged by its own text while it is read, so
    a null or repeated id decides nothing. Without labels all rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "quality")
    known = _known(labels)
    some = marked(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), ["doc_id"], known).where("_maybe").select("doc_id", "text")
    measured = _measured(some, "doc_id long")  # before the join, so that no text is shuffled
    labelled = scratch.keep(measured.join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("part")))
    model = spark.sparkContext.broadcast(_fit(labelled, scratch))
    scratch.drop(labelled)

    def judge(batches):
        for b in batches:
            if b.num_rows:
                score = model.value.score(np.array([statistics(t) for t in b.column("text").to_pylist()]))
                yield b.filter(pa.array(score >= CUT))
        trim()

    return docs.mapInArrow(judge, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`assess` over the whole table, learned from the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = assess(docs, labels.where(fold("doc_id", 5) != 0))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
