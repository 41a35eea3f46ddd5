"""Run-length encoding as relations: (run, value, repeats)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.operators import position
from tabulith.operators.position import CHUNK, chunked, in_chunk


#: Rows of a run that become rows at once.
PIECE_ROWS = 65_536


def encode(df: DataFrame, key: str, value: str, rows: int | None = None) -> DataFrame:
    """run (from 1), value, repeats of the adjacent equal values in the order of key.

    Null equals null and NaN equals NaN. Runs are found in each chunk; the last run of a
    chunk and the first of the next are one if their values are equal, which is settled
    on one row a run at a chunk's edge. An empty table has no runs.
    """
    parts = chunked(df.select(F.col(key).alias("_key"), F.col(value).alias("value")), "_key", rows)
    order = in_chunk("_key")
    fresh = F.when(F.row_number().over(order) == 1, 1).when(F.col("value").eqNullSafe(F.lag("value").over(order)), 0).otherwise(1)
    marked = parts.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.groupBy(CHUNK, "_run").agg(F.min_by("value", "_key").alias("value"), F.count("*").alias("repeats"))
    # one row a chunk: its first and last value and its runs
    edges = local.groupBy(CHUNK).agg(F.min_by("value", "_run").alias("_first"), F.max_by("value", "_run").alias("_last"), F.max("_run").alias("_runs"))
    by = Window.orderBy(CHUNK)
    joined = F.when(F.row_number().over(by) == 1, 0).otherwise(F.col("_first").eqNullSafe(F.lag("_last").over(by)).cast("int"))
    edges = edges.withColumn("_joined", joined).select(CHUNK, (F.coalesce(F.sum("_runs").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_joined").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("_offset"))
    numbered = local.join(F.broadcast(edges), CHUNK).withColumn("run", F.col("_run") + F.col("_offset"))
    return numbered.groupBy("run").agg(F.first("value").alias("value"), F.sum("repeats").alias("repeats")).select(F.col("run").cast("long").alias("run"), "value", "repeats")


def bounds(runs: DataFrame) -> DataFrame:
    """runs with start and end (exclusive), the positions that each covers."""
    from tabulith.operators.position import running

    return running(runs, "run", F.col("repeats"), "start", dense=True).withColumn("end", F.col("start") + F.col("repeats"))


def pieces(runs: DataFrame) -> DataFrame:
    """value, first, last: every run cut into pieces of PIECE_ROWS positions at most; zero repeats give none."""
    cut = bounds(runs).where("repeats > 0").select("value", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(PIECE_ROWS).cast("long"))).alias("first"))
    return cut.select("value", "first", (F.least(F.col("first") + PIECE_ROWS, "end") - 1).alias("last"))


def decode(runs: DataFrame) -> DataFrame:
    """_pos, value: every run expanded.

    Only a piece of a run becomes rows at once, so one of any length is made row by row.
    """
    return pieces(runs).select(F.explode(F.sequence("first", "last")).alias("_pos"), "value")


def stats(runs: DataFrame) -> DataFrame:
    """runs, rows, longest, shortest of an encoded column."""
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("rows"), F.max("repeats").alias("longest"), F.min("repeats").alias("shortest"))


def lookup(runs: DataFrame, positions: DataFrame, rows: int | None = None) -> DataFrame:
    """_pos and value for positions(_pos), without expanding: a position belongs to the last run that starts at or before it."""
    rows = rows or position.CHUNK_ROWS
    found = bounds(runs).select(F.col("start").alias("_pos"), F.struct("end", "value").alias("run"))
    # a chunk's last run is carried to the chunks up to the next one with a run: a row a chunk
    last = chunked(found, "_pos", rows, dense=True).groupBy(CHUNK).agg(F.max_by("run", "_pos").alias("carried"))
    end = F.floor((F.max("carried.end").over(Window.partitionBy()) - 1) / rows).cast("int")
    until = F.coalesce(F.lead(CHUNK).over(Window.orderBy(CHUNK)), end)
    last = last.withColumn("until", until).where(F.col("until") > F.col(CHUNK)).select(F.explode(F.sequence(F.col(CHUNK) + 1, "until")).alias(CHUNK), "carried")
    asked = positions.select(F.col("_pos").cast("long").alias("_pos"), F.lit(None).cast(found.schema["run"].dataType).alias("run"))
    both = chunked(found.withColumn("_ask", F.lit(0)).unionByName(asked.withColumn("_ask", F.lit(1))), "_pos", rows, dense=True)
    here = F.last("run", True).over(Window.partitionBy(CHUNK).orderBy("_pos", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("run", here).where("_ask = 1").join(F.broadcast(last), CHUNK, "left").withColumn("run", F.coalesce("run", "carried"))
    return out.where("_pos < run.end").select("_pos", F.col("run.value").alias("value"))


def total(runs: DataFrame) -> DataFrame:
    """The sum of a numeric column from its runs alone."""
    return runs.agg(F.sum(F.col("value") * F.col("repeats")).alias("total"))
