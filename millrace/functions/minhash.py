"""Shingles and MinHash signatures as column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multipliers of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shingles that are remixed for all seeds at once; bounds what lies in the cache.
BLOCK = 256


def paragraph_shingles(text: Column, k: int) -> Column:
    """Distinct k-grams of lower-case words, within lines only; short lines give none."""
    # words are bound to a lambda's variable: an expression used inside another lambda is evaluated for each element
    lines = F.transform(F.split(F.lower(text), "\n", -1), lambda line: F.filter(F.split(line, r"\s+", -1), lambda x: x != ""))
    long = F.filter(lines, lambda words: F.size(words) >= k)

    def grams(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))

    return F.array_distinct(F.flatten(F.transform(long, grams)))


def signature(shingles: Column, permutations: int) -> Column:
    """Smallest of 32 bits of md5(seed:shingle) per seed; null for no shingles. Portable to any engine with md5."""

    # the first 8 hexadecimal digits order as the numbers that they write, so only the smallest is converted
    def least(grams: Column, seed: int) -> Column:
        first = F.array_min(F.transform(grams, lambda x: F.substring(F.md5(F.concat(F.lit(f"{seed}:"), x).cast("binary")), 1, 8)))
        return F.conv(first, 16, 10).cast("long")

    every = lambda grams: F.when(F.size(grams) > 0, F.array(*[least(grams, s) for s in range(permutations)]))
    return F.get(F.transform(F.array(shingles), every), 0)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of xxhash64, in place."""
    for shift, factor in ((33, _P2), (29, _P3)):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(32)
    return x


def least_remixed(hashes: np.ndarray, permutations: int) -> np.ndarray:
    """For each seed the smallest of Spark's ``xxhash64(hash, seed)``, as signed numbers."""
    x = np.asarray(hashes, np.int64).view(np.uint64)
    first = _mixed(_turned((np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4) + _P5 + np.uint64(4)
    seeds = (np.arange(permutations, dtype=np.uint64) * _P1)[:, None]
    least = np.full(permutations, np.iinfo(np.int64).max)
    for at in range(0, len(first), BLOCK):
        every = _turned(first[None, at : at + BLOCK] ^ seeds, 23)
        every *= _P2
        every += _P3
        np.minimum(least, _mixed(every).view(np.int64).min(axis=1), out=least)
    return least


def fast_signatures(rows: DataFrame, key: str, shingles: Column, permutations: int) -> DataFrame:
    """``key, sig`` of the rows with shingles: as :func:`signature`, by one 64-bit hash per shingle, remixed for each seed in arrays; for production."""

    def run(batches):
        for b in batches:
            ids, hashes = b.column(key), b.column("_h")
            some = [i for i in range(len(hashes)) if hashes[i].is_valid and len(hashes[i])]
            sigs = [least_remixed(hashes[i].values.to_numpy(), permutations) for i in some]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some, pa.int32())), pa.array(sigs, pa.list_(pa.int64()))], [key, "sig"])

    hashed = rows.select(key, F.transform(shingles, lambda x: F.xxhash64(x)).alias("_h"))
    return hashed.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, sig array<long>")


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """One key per band of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_join(F.slice(sig, b * rows + 1, rows).cast("array<string>"), "-"))
