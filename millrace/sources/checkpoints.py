"""Checkpoints of a run: the latest, the champion, and the cache of what was extracted from a corpus snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import exists

LATEST, CHAMPION = "latest", "champion"


def _replace(spark: SparkSession, source: str, target: str) -> str:
    """Copies a file or folder beside the target, then renames: readers see the old or the new one, and a broken copy is never the target."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    if fs.getScheme() == "file":
        fs = fs.getRaw()  # trainers write there without Hadoop's checksum files
    copy, old = f"{target}.{uuid.uuid4().hex}.tmp", f"{target}.{uuid.uuid4().hex}.old"
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(source), fs, path(copy), False, conf)
    if fs.exists(path(target)):
        fs.rename(path(target), path(old))
    if not fs.rename(path(copy), path(target)):
        raise OSError(f"{copy} could not be renamed to {target}")
    fs.delete(path(old), True)
    return target


def promote(spark: SparkSession, folder: str) -> str:
    """Makes the latest checkpoint the champion; an error without one."""
    if not exists(spark, f"{folder}/{LATEST}"):
        raise FileNotFoundError(f"no checkpoint to promote: {folder}/{LATEST}")
    return _replace(spark, f"{folder}/{LATEST}", f"{folder}/{CHAMPION}")


def rollback(spark: SparkSession, folder: str) -> str:
    """Makes the champion the latest checkpoint again, after a rejection; an error without one."""
    if not exists(spark, f"{folder}/{CHAMPION}"):
        raise FileNotFoundError(f"no champion to restore: {folder}/{CHAMPION}")
    return _replace(spark, f"{folder}/{CHAMPION}", f"{folder}/{LATEST}")


def cached(spark: SparkSession, folder: str, inventory: str, extract: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """What ``extract`` gives for a corpus snapshot, and whether it was stored already: it runs again only when the inventory's hash changed."""
    path, marker = f"{folder}/inventory={inventory}", f"{folder}/inventory={inventory}/_SUCCESS"
    known = exists(spark, marker)
    if not known:
        extract().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), known
