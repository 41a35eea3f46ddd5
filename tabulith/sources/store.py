"""The result store: named tables as Parquet folders under one path, with a catalogue."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.types import compatible, logical_type, reinterpret


class Store:
    """Tables of a store are folders whose names are the tables' names, quoted; any name will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{quote(name, safe='')}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def names(self) -> list[str]:
        files, path = self._fs()
        if not files.exists(path):
            return []
        return sorted(unquote(s.getPath().getName()) for s in files.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith("_"))

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists", sort_by: str | None = None) -> None:
        """Write or, with mode append, add to a table of the same columns. sort_by lets readers skip row groups by that column."""
        check_names(df)
        if mode == "append" and name in self.names():
            known = [(f.name, f.dataType) for f in self.table(name).schema]
            if known != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError(f"table {name} has other columns")
        if sort_by:
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        df.write.mode(mode).parquet(self._folder(name))

    def publish(self, name: str, df: DataFrame) -> str:
        """Add a result: to the table of that name if its columns are the same, else under a name with a number."""
        wanted, n = name, 1
        while wanted in self.names() and [(f.name, f.dataType) for f in self.table(wanted).schema] != [(f.name, f.dataType) for f in df.schema]:
            n += 1
            wanted = f"{name}~{n}"
        self.write(wanted, df, "append")
        return wanted

    def has(self, name: str) -> bool:
        return name in self.names()

    def size(self) -> int:
        """Bytes of all files of the store."""
        files, path = self._fs()
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(name))

    def column(self, table: str, column: str, logical: str | None = None) -> DataFrame:
        """One column; only it is read. As another type only if the two are compatible."""
        df = self.table(table).select(column)
        return df if logical is None else as_type(df, column, logical)

    def catalogue(self) -> DataFrame:
        return columns_frame(self.spark, {n: self.table(n) for n in self.names()})


def check_names(df: DataFrame) -> None:
    """Names must differ, also for readers that don't tell upper from lower case."""
    lower = [c.lower() for c in df.columns]
    if len(set(lower)) < len(lower):
        raise ValueError(f"columns {df.columns} have clashing names")


def as_type(df: DataFrame, column: str, logical: str) -> DataFrame:
    """A column read as a compatible logical type: signed as unsigned and back, text as bytes and back."""
    own = logical_type(df.schema[column])
    if own == logical:
        return df
    if not compatible(own, logical):
        raise TypeError(f"{column} is {own}, which cannot be read as {logical}")
    value = F.col(column).cast("binary" if logical == "Blob" else "string") if logical in ("Blob", "String") else reinterpret(F.col(column), logical)
    return df.withColumn(column, value.alias(column, metadata={"logical_type": logical}))


def tables_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, columns of each table."""
    return spark.createDataFrame([(n, len(df.columns)) for n, df in tables.items()], "name string, columns long")


def columns_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, ordinal (from 0), column, logical type of each column; nested ones have none."""
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            rows.append((name, i, f.name, None if nested else logical_type(f)))
    return spark.createDataFrame(rows, "table string, ordinal long, column string, logical string")


def lengths_frame(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table, counted side by side in one plan."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def union_of(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; what a table lacks is null."""
    out = tables[0].select("*")  # untyped, as rows of a typed range cannot grow columns
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
