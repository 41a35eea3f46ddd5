"""Capture of published results as a stream, and the tables that go with a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabulith.sources.store import Store

ANCESTRY, PARAMS = "__ancestry__", "__params__"
# The codes of the types that a parameter's value can have.
TYPE_CODES = {"boolean": 3, "tinyint": 5, "smallint": 7, "int": 9, "bigint": 11, "float": 13, "double": 14, "decimal": 15, "timestamp": 16, "string": 18}


def capture(stream: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every batch of a stream of results to a table of the store.

    A batch is written under its number, and one that is run again replaces itself, so each
    result is there once whatever fails.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(store._folder(name))

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route(stream: DataFrame, store: Store, step: str, result: str, checkpoint: str) -> StreamingQuery:
    """Results of many steps in one stream: each goes to the table `step/result`, by the values of two columns.

    Tables are folders of one partitioned write, so the number of distinct names never
    makes a loop over the data.
    """

    def publish(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("_table", F.concat_ws("/", F.col(step), F.col(result))).withColumn("_batch", F.lit(number))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_table", "_batch").parquet(store._folder("results"))

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ancestry(steps: DataFrame, id_: Column, parent: Column, name: Column, plan: tuple[str, str] | None = None) -> DataFrame:
    """id, parent, name of every step, and of the plan, which has no parent."""
    rows = steps.select(id_.cast("string").alias("id"), parent.cast("string").alias("parent"), name.cast("string").alias("name"))
    if plan is None:
        return rows
    return rows.unionByName(steps.sparkSession.createDataFrame([(plan[0], None, plan[1])], "id string, parent string, name string"))


def type_code(kind: T.DataType) -> int:
    return TYPE_CODES.get(kind.simpleString().split("(")[0], TYPE_CODES["string"])


def parameters(runs: DataFrame, id_: str, groups: dict[str, str | None] | None = None) -> DataFrame:
    """id, names, type, value: one row for each run and other column.

    A parameter's name is its group and name; type is the code of the column's type, and
    the value is text. All columns become rows in one pass.
    """
    groups = groups or {}
    each = [c for c in runs.columns if c != id_]
    full = lambda c: f"{groups[c]}/{c}" if groups.get(c) else c
    entries = F.array(*[F.struct(F.lit(full(c)).alias("names"), F.lit(type_code(runs.schema[c].dataType)).alias("type"), F.col(c).cast("string").alias("value")) for c in each])
    return runs.select(F.col(id_).cast("string").alias("id"), F.explode(entries).alias("p")).select("id", "p.names", "p.type", "p.value")


@dataclass
class Listener:
    """The life of a run: results are published as they come, steps are noted, and the end writes the two tables.

    The store is readable at every moment; a run that breaks off lacks only those two.
    """

    store: Store
    plan: tuple[str, str]
    steps: list[tuple[str, str | None, str]] = field(default_factory=list)

    def result(self, step: str, name: str, df: DataFrame) -> str:
        return self.store.publish(f"{step}/{name}", df)

    def step(self, id_: str, parent: str | None, name: str) -> None:
        self.steps.append((id_, parent, name))

    def complete(self, runs: DataFrame, id_: str, groups: dict[str, str | None] | None = None) -> None:
        spark: SparkSession = self.store.spark
        rows = [*self.steps, (self.plan[0], None, self.plan[1])]
        self.store.write(ANCESTRY, spark.createDataFrame(rows, "id string, parent string, name string"), "overwrite")
        self.store.write(PARAMS, parameters(runs, id_, groups), "overwrite")
