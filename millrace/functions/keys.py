"""Rows told apart by keys without a shuffle of what is wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter below and of one row of it; 2 MB in all, whatever the number of rows.
FILTER_BITS, ROW_BITS = 1 << 24, 32768


def marked(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``_maybe``: false only where their ``keys``, which are never null, are surely not among those of ``wanted``.

    A fixed-size bitmap of hashed keys is broadcast, so wide rows need no shuffle to be told apart;
    with very many keys it fills up and more rows are marked, never fewer.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    bits = (
        wanted.select(slot.alias("s"))
        .groupBy((F.col("s") / ROW_BITS).cast("int").alias("_filter_row"))
        .agg(F.expr(f"bitmap_construct_agg(s % {ROW_BITS})").alias("_filter_bits"))
    )
    at = rows.withColumn("_filter_slot", slot).withColumn("_filter_row", (F.col("_filter_slot") / ROW_BITS).cast("int"))
    byte = F.conv(F.hex(F.expr(f"substring(_filter_bits, cast((_filter_slot % {ROW_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("_filter_slot") % 8).cast("int")) != 0, F.lit(False))
    return at.join(F.broadcast(bits), "_filter_row", "left").withColumn("_maybe", hit).drop("_filter_row", "_filter_slot", "_filter_bits")


def with_keys(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose ``keys`` are among those of ``wanted``; only rows that pass the bitmap are shuffled."""
    return marked(rows, keys, wanted).where("_maybe").drop("_maybe").join(wanted.select(*keys), keys, "left_semi")


def without_keys(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The other rows."""
    some = marked(rows, keys, wanted)
    rest = some.where("_maybe").drop("_maybe").join(wanted.select(*keys), keys, "left_anti").select(*rows.columns)
    return some.where("not _maybe").drop("_maybe").unionByName(rest)
