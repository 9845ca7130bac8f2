"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches, trim

#: Buckets of hashed byte trigrams, centroids per language, distinct labelled texts per language that fit them (bounded sample), bits of the hash that picks them.
BUCKETS, CENTROIDS, PER_LANGUAGE, HASH_BITS = 8192, 4, 400, 62
#: A document farther from every centroid than this share of the similarity that all but 1 in 200 sampled documents of its length reach is rejected.
REJECT_SHARE, REJECT_QUANTILE = 0.3, 0.005
#: Upper ends, in n-grams, of the length classes for rejection.
LENGTHS = (16, 64, 256, 1024)
#: Label of texts without a letter.
UNDEFINED = "und"

_letter = regex.compile(r"\p{L}")


def grams(text: str) -> tuple[np.ndarray, int]:
    """Counts by bucket of the byte trigrams of the lower-cased letters and spaces, and their number."""
    b = np.frombuffer(_fold(text), np.uint8).astype(np.uint32)
    codes = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return np.bincount(codes >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS), len(codes)


#: Everything but letters in ASCII becomes a space.
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _fold(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_TABLE) + b"  "


def length_class(n: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, side="left")


@dataclass
class Centroids:
    """Inverse document frequencies, unit centroids with their language, and the least similarity by length class."""

    idf: np.ndarray
    matrix: np.ndarray
    of: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        return (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: list[str], df: np.ndarray, n: int, seed: int = 3) -> Centroids:
        """Spherical k-means within each language over sampled documents; document frequencies come from all labelled ones."""
        languages = sorted(set(labels))
        model = cls(np.log((1 + n) / (1 + df)) + 1, np.zeros((1, BUCKETS), np.float32), np.zeros(1, int), languages, np.zeros(len(LENGTHS) + 1))
        x = np.array([model.vector(c) for c in counts], np.float32).reshape(-1, BUCKETS)
        rng, labels_a, matrix, of = np.random.default_rng(seed), np.array(labels), [], []
        for i, language in enumerate(languages):
            own = x[labels_a == language]
            centres = own[rng.choice(len(own), min(CENTROIDS, len(own)), replace=False)].copy()
            for _ in range(8):
                near = (own @ centres.T).argmax(axis=1)
                for c in np.unique(near):
                    mean = own[near == c].sum(axis=0)
                    centres[c] = mean / (np.linalg.norm(mean) or 1.0)
            matrix.append(centres)
            of += [i] * len(centres)
        if languages:
            model.matrix, model.of = np.concatenate(matrix), np.array(of)
            best, size = (x @ model.matrix.T).max(axis=1), length_class(counts.sum(axis=1))
            model.floors = np.array([REJECT_SHARE * np.quantile(best[size == c], REJECT_QUANTILE) if (size == c).any() else np.inf for c in range(len(LENGTHS) + 1)])
            model.floors = np.minimum.accumulate(model.floors[::-1])[::-1]  # a shorter text is never held to more
            model.floors = np.where(np.isinf(model.floors), model.floors[np.isfinite(model.floors)].max(initial=0.0), model.floors)  # lengths without a sample
        return model

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, share of similarity (0 to 1) and whether the text is too far from every centroid."""
        if not text or not _letter.search(text) or not self.languages:
            return UNDEFINED, 0.0, True
        counts, n = grams(text)
        alike = self.matrix @ self.vector(counts)
        best = int(alike.argmax())
        score = float(min(1.0, max(0.0, alike[best])))
        return self.languages[self.of[best]], score, bool(score < self.floors[int(length_class(n))])


def _limits(rows: DataFrame, wanted: int) -> dict[str, int]:
    """Per language, the bound under which about ``wanted`` distinct hashes ``u`` lie, or twice as many; above all of them if there are fewer.

    Distinct hashes are counted by their leading zeros: 32 sketches a language, whatever repeats.
    """
    zeros = (F.lit(HASH_BITS) - F.length(F.bin("u"))).alias("zeros")
    found = rows.groupBy("lang", zeros).agg(F.approx_count_distinct("u", 0.05).alias("n")).collect()
    limits, sums = {}, {}
    for r in sorted(found, key=lambda r: -r["zeros"]):
        if sums.get(r["lang"], 0) < wanted:
            sums[r["lang"]] = sums.get(r["lang"], 0) + r["n"]
            limits[r["lang"]] = 1 << HASH_BITS - r["zeros"] if sums[r["lang"]] >= wanted else 1 << HASH_BITS
    return limits


def _by_language(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[F.col("lang")]


def train(labelled: DataFrame) -> Centroids:
    """Fits on ``labelled(text, lang)``: document frequencies are summed over all rows, centroids are fitted on a bounded sample.

    The sample is, per language, the PER_LANGUAGE distinct texts of least hash: the same in every run,
    and never without a language that has a row, however often its texts repeat.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")
    rows = rows.withColumn("u", F.xxhash64("text").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    limits = _limits(rows, PER_LANGUAGE + PER_LANGUAGE // 4)
    if not limits:
        return Centroids.fit(np.empty((0, BUCKETS), np.int32), [], np.zeros(BUCKETS, np.int64), 0)
    rows = rows.withColumn("u", F.when(F.col("u") < _by_language(limits), F.col("u")))

    def run(batches):
        df, n, seen = np.zeros(BUCKETS, np.int64), 0, set()
        for b in batches:
            out = [[], [], []]
            for text, lang, u in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "u")), strict=True):
                c, _ = grams(text)
                df += c > 0
                n += 1
                if u is not None and (lang, u) not in seen:
                    seen.add((lang, u))
                    for x, v in zip(out, (lang, u, zlib.compress(c.astype(np.int32).tobytes(), 1)), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array([1] * len(out[0]), pa.int64())], ["lang", "u", "counts", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["lang", "u", "counts", "n"])

    scratch = Scratch(spark, "language")
    found = scratch.keep(rows.mapInArrow(run, "lang string, u long, counts binary, n long"))

    def add(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for c, k in zip(b.column("counts").to_pylist(), b.column("n").to_pylist(), strict=True):
                df += np.frombuffer(c, np.int64)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["counts", "n"])

    sums = found.where("lang is null").select("counts", "n").coalesce(16).mapInArrow(add, "counts binary, n long").collect()
    df = sum((np.frombuffer(r["counts"], np.int64) for r in sums), np.zeros(BUCKETS, np.int64))
    picked = found.where("lang is not null")
    hashes: dict[str, list[int]] = {}
    for r in picked.select("lang", "u").distinct().collect():  # a few times PER_LANGUAGE a language
        hashes.setdefault(r["lang"], []).append(r["u"])
    last = {lang: sorted(u)[:PER_LANGUAGE][-1] for lang, u in hashes.items()}
    sample = picked.where(F.col("u") <= _by_language(last)).dropDuplicates(["lang", "u"]).select("lang", "u", "counts").collect()
    sample = sorted((r["lang"], r["u"], bytes(r["counts"])) for r in sample)
    scratch.drop(found)
    vectors = np.array([np.frombuffer(zlib.decompress(c), np.int32) for *_, c in sample], np.int32).reshape(-1, BUCKETS)
    return Centroids.fit(vectors, [lang for lang, *_ in sample], df, sum(r["n"] for r in sums))


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Language of every whole text of ``docs(doc_id, text)``, learned from ``labelled(text, lang)``.

    A null text, or one without a letter, is ``und`` with score 0 and counts as rejected; any other
    text gets its nearest centroid's language, and is rejected if even that is too far. Without
    labelled rows all are ``und``. Every language that has a labelled row is known, however often its
    rows repeat. Ties go to the first language by name; repeated rows are judged each; very long texts
    are read whole; an empty table gives no rows. Other columns of ``docs`` pass through, unless they clash.
    Returns the columns of ``docs`` and ``lang_pred, lang_score, rejected``.
    """
    spark = docs.sparkSession
    model = train(labelled)
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)  # a fixed number of centroids per language
    keep = docs.drop("lang_pred", "lang_score", "rejected")
    schema = ", ".join(f"`{c}` {t}" for c, t in keep.dtypes) + ", lang_pred string, lang_score double, rejected boolean"

    def run(batches):
        for b in batches:
            got = [held.value.predict(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "lang_pred", "lang_score", "rejected"])
        trim()

    return keep.mapInArrow(run, schema)


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`identify` over the whole table, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    out = identify(docs.select("doc_id", "text"), docs.where(fold("doc_id", 4) != 2))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")
