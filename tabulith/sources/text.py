"""Text formats: CSV whose columns are all text, rendered lines, pipe-separated tables, DDL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.operators.position import POS


def read_csv(spark: SparkSession, path: str, lines_in_cells: bool = True) -> DataFrame:
    """A CSV file with a header; every column is text and a short row has empty text in the columns it lacks.

    Cells may hold line ends in quotes, and then a file is read by one task; without
    lines_in_cells large files are split.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", lines_in_cells).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, null as empty text."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def csv_cell(value: Column) -> Column:
    """A value as text: null is empty, text with a comma is in quotes, bytes are hexadecimal; nothing is escaped."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.contains(text, F.lit(",")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def _cells(df: DataFrame) -> list[Column]:
    binary = {f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)}
    return [csv_cell(F.hex(c) if c in binary else F.col(c)) for c in df.columns if c != POS]


def csv_lines(df: DataFrame, order: str) -> DataFrame:
    """line_no (0 is the header), line, in the order of a unique column (`_pos` itself is not rendered)."""
    from tabulith.operators.position import with_position

    names = [c for c in df.columns if c != POS]
    placed = df if order == POS else with_position(df, order)
    head = df.sparkSession.createDataFrame([(0, ",".join(names))], "line_no long, line string")
    return head.unionByName(placed.select((F.col(POS) + 1).alias("line_no"), F.concat_ws(",", *_cells(df)).alias("line")))


def csv_tables(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_no, line_no, line of several tables in one file; each is headed by its name, unless there is only one."""
    out = None
    for i, (name, (df, order)) in enumerate(tables.items()):
        lines = csv_lines(df, order).select(F.lit(i).alias("table_no"), "line_no", "line")
        if len(tables) > 1:
            lines = lines.unionByName(df.sparkSession.createDataFrame([(i, -1, name)], "table_no int, line_no long, line string"))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write lines as one text file in their order: a format of single files, for exports that fit one."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


# SQL types of table definitions and the types they are read as.
DDL_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DECIMAL": "float", "CHAR": "string", "VARCHAR": "string", "DATE": "string"}


def parse_ddl(text: str, leave_out: tuple[str, ...] = ()) -> dict[str, T.StructType]:
    """The tables of CREATE TABLE statements and their columns."""
    out = {}
    for name, body in re.findall(r"create\s+table\s+(\w+)\s*\((.*?)\)\s*;", text, re.IGNORECASE | re.DOTALL):
        if name.upper() in leave_out:
            continue
        columns = re.findall(r"^\s*(\w+)\s+([A-Za-z]+)", body, re.MULTILINE)
        out[name] = T.StructType.fromDDL(", ".join(f"`{c}` {DDL_TYPES[k.upper()]}" for c, k in columns if k.upper() in DDL_TYPES))
    return out


def parse_tbl(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Pipe-separated lines as typed rows: parts are trimmed and empty ones dropped; what is no number is null."""
    parts = F.filter(F.transform(F.split(F.col(column), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select(parts.alias("p"))
    return rows.select(*[F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def tbl_lines(df: DataFrame) -> DataFrame:
    """value: rows as pipe-separated lines, each value followed by a pipe."""
    return df.select(F.concat(*[x for c in df.columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"))]).alias("value"))
