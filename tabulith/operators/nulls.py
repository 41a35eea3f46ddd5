"""Null split and merge: a bitmap (1 is null, least bit first) and the dense values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.operators.position import running


def bitmap(df: DataFrame, value: str, pos: str = "_pos") -> DataFrame:
    """byte_index, bits (0 to 255): bit pos % 8 of byte pos div 8 is set where value is null."""
    bit = F.when(F.col(value).isNull(), F.expr(f"shiftleft(1, cast({pos} % 8 as int))")).otherwise(0)
    return df.groupBy(F.expr(f"{pos} div 8").alias("byte_index")).agg(F.sum(bit).alias("bits"))


def bitmap_bytes(length: int) -> int:
    """Bytes that a stored bitmap has: a last one is there even if no bit is in it."""
    return length // 8 + 1


def dense(df: DataFrame, value: str, pos: str = "_pos") -> DataFrame:
    """dense_pos, value: the values that are not null, in their order, without gaps."""
    some = df.where(F.col(value).isNotNull()).select(pos, F.col(value).alias("value"))
    return running(some, pos, F.lit(1), "dense_pos", dense=True).select("dense_pos", "value")


def merge(bits: DataFrame, values: DataFrame, length: int) -> DataFrame:
    """_pos, value: the inverse, from byte_index, bits and dense_pos, value, for `length` rows.

    Bytes that are missing count as 0; what a bitmap has beyond length is passed over.
    """
    spark = values.sparkSession
    each = spark.range(length).withColumnRenamed("id", "_pos").withColumn("byte_index", F.expr("_pos div 8"))
    known = each.join(bits, "byte_index", "left").withColumn("null", F.expr("shiftright(coalesce(bits, 0), cast(_pos % 8 as int)) & 1 = 1"))
    placed = running(known, "_pos", (~F.col("null")).cast("int"), "dense_pos", dense=True).select("_pos", F.when(~F.col("null"), F.col("dense_pos")).alias("dense_pos"))
    return placed.join(values, "dense_pos", "left").select("_pos", "value")
