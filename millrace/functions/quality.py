"""Column functions of the quality rules and the weighted score."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from functools import cache
from pathlib import Path

import pyspark
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import CLEAN, CleanConfig
from millrace.functions.text import IN_BREAKS, IN_LINE

# Characters that close a line.
LINE_CLOSERS = ".!?'\"”’):;]"
# Weights of the score's parts, in the order they are added.
WEIGHTS = {"stopword": 0.40, "symbol": 0.20, "punct": 0.25, "word_len": 0.15}


@cache
def stopwords() -> tuple[str, ...]:
    """Spark's public English list, from its jar; so no session is needed to write SQL with it."""
    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            return tuple(sorted(set(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")) - {""}))
    return tuple(sorted(set(StopWordsRemover.loadDefaultStopWords("english"))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where there is nothing; each is evaluated once."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def listed_share(items: Column, test: Callable[[Column], Column]) -> Column:
    """Share of the elements that pass ``test``; the array is built once, as a lambda's variable."""
    some = F.coalesce(items, F.array().cast("array<string>"))
    return F.get(F.transform(F.array(some), lambda a: share(F.size(F.filter(a, test)), F.size(a))), 0)


def mean_word_len(text: Column) -> Column:
    # words are taken once and their letters counted together: to take out all that is none costs several times as much
    some = F.coalesce(words(text), F.array().cast("array<string>"))
    return F.get(F.transform(F.array(some), lambda a: share(F.length(F.array_join(a, "")), F.size(a))), 0)


def symbol_ratio(text: Column) -> Column:
    return share(F.length(F.regexp_replace(text, "[a-zA-Z0-9 ]+", "")), F.length(text))


def punct_line_frac(text: Column) -> Column:
    """Share of the lines with more than white space that end in a closer. Both are counted over the whole text, without making its lines."""
    filled = F.regexp_count(text, F.lit(rf"(?:\A|[{IN_BREAKS}])[{IN_LINE}]*[^{IN_BREAKS}{IN_LINE}]"))
    closed = F.regexp_count(text, F.lit("[" + "".join(f"\\x{{{ord(c):X}}}" for c in LINE_CLOSERS) + rf"](?=[{IN_LINE}]*+(?:[{IN_BREAKS}]|\z))"))
    return share(closed, filled)


def stopword_ratio(text: Column, stop: tuple[str, ...] | None = None) -> Column:
    return listed_share(words(F.lower(text)), lambda x: x.isin(*(stop or stopwords())))


def violations(mean_len: Column, symbols: Column, punct: Column, stop: Column, cfg: CleanConfig = CLEAN, symbol_max: Column | None = None, punct_min: Column | None = None) -> Column:
    """Names of broken rules in fixed order, from the four features."""
    return F.array_compact(
        F.array(
            F.when(~mean_len.between(*cfg.word_len), "mean_word_len"),
            F.when(symbols > (F.lit(cfg.symbol_max) if symbol_max is None else symbol_max), "symbol_ratio"),
            F.when(punct < (F.lit(cfg.punct_min) if punct_min is None else punct_min), "punct_lines"),
            F.when(stop < cfg.stop_min, "stopword_ratio"),
        )
    )


def quality_score(mean_len: Column, symbols: Column, punct: Column, stop: Column, symbol_max: float = CLEAN.symbol_max) -> Column:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return (
        WEIGHTS["stopword"] * clip(stop / 0.45)
        + WEIGHTS["symbol"] * clip(1 - symbols / max(symbol_max, 1e-9) / 1.5)
        + WEIGHTS["punct"] * clip(punct / 0.95)
        + WEIGHTS["word_len"] * clip(1 - F.abs(mean_len - 6.5) / 3.5)
    )
