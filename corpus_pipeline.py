"""Training-data pipeline over ``documents``: language, quality, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import Scratch
from millrace.llm.language import fold, identify
from millrace.llm.minhash import one_of_each
from millrace.llm.packing import pack_documents
from millrace.llm.pii import redact
from millrace.llm.quality import good_documents

#: Words of a shingle and percentage of shared shingles from which documents are near duplicates.
WIDTH, PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: without a letter, or far from every centroid. Each row is judged by its text, whatever its id."""
    judged = identify(docs, docs.where(fold("doc_id", 4) != 2))
    return judged.where("not rejected").select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts to be bad; learned from the labels that are not held out. Each row is judged by its text, whatever its id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return good_documents(docs, labels)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, a null id only where none has one. Rows that repeat an id are documents of their own, by their texts."""
    return one_of_each(docs, WIDTH, PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts of all rows, also of those with a null or repeated id."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into training sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Classifiers, near-duplicate groups under 5-word MinHash and token ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
    return docs
