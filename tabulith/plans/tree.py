"""The encoding tree of tables: nodes with parents, numbered from the root down, listed leaves first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulith.functions.types import TAGS, WIDTHS, logical_type

# Tags of encodings.
ENCODING_TAGS = {"Table": 0, "Binary": 1, "Split": 2, "BitPacking": 3, "Null": 4, "RunLength": 5}

SCHEMA = "id int, parent_id int, encoding string, logical string, name string"


def column_nodes(schema: T.StructType, nullable: set[str] = frozenset()) -> list[tuple]:
    """(encoding, logical type, name, parts) of each column of a plain table."""
    out = []
    for f in schema.fields:
        logical = logical_type(f)
        node = ("Binary", logical, f.name, [])
        if WIDTHS[logical] is None:
            node = ("Split", logical, f.name, [("Binary", "SInt32", "lengths", []), ("Binary", "UInt8", "bytes", [])])
        if f.name in nullable:
            node = ("Null", logical, f.name, [("Binary", "UInt8", "bitmap", []), node])
        out.append(node)
    return out


def number(name: str, columns: list[tuple], first: int = 0) -> list[tuple]:
    """Rows of SCHEMA for one table: ids from the root down, rows from the leaves up."""
    rows: list[tuple] = []
    last = first

    def visit(node: tuple, parent: int) -> None:
        nonlocal last
        mine = last
        last += 1
        for part in node[3]:
            visit(part, mine)
        rows.append((mine, parent, node[0], node[1], node[2]))

    visit(("Table", "UInt8", name, columns), -1)
    return rows


def tree(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The nodes of all tables, one after another."""
    rows: list[tuple] = []
    for name, df in tables.items():
        rows += number(name, column_nodes(df.schema), len(rows))
    return spark.createDataFrame(rows, SCHEMA)


DEPTHS = """
WITH RECURSIVE reached(id, parent_id, encoding, logical, name, depth) AS (
    SELECT id, parent_id, encoding, logical, name, 0 FROM {nodes} WHERE parent_id = -1
    UNION ALL
    SELECT n.id, n.parent_id, n.encoding, n.logical, n.name, r.depth + 1
    FROM {nodes} n JOIN reached r ON n.parent_id = r.id
)
SELECT id, parent_id, encoding, logical, name, depth FROM reached
"""


def depths(nodes: DataFrame) -> DataFrame:
    """Every node with its depth below its table."""
    return nodes.sparkSession.sql(DEPTHS.format(nodes="{nodes}"), nodes=nodes)


def children(nodes: DataFrame, parent: int) -> DataFrame:
    return nodes.where(nodes["parent_id"] == parent).orderBy("id")


def descendants(nodes: DataFrame, root: int) -> DataFrame:
    """Every node below root, by a recursive query."""
    query = f"""
    WITH RECURSIVE below(id) AS (
        SELECT id FROM {{nodes}} WHERE parent_id = {int(root)}
        UNION ALL SELECT n.id FROM {{nodes}} n JOIN below b ON n.parent_id = b.id
    ) SELECT n.* FROM {{nodes}} n JOIN below b ON n.id = b.id"""
    return nodes.sparkSession.sql(query, nodes=nodes)


def replace(nodes: DataFrame, node: int, encoding: str) -> DataFrame:
    """The tree with another encoding at one node."""
    from pyspark.sql import functions as F

    return nodes.withColumn("encoding", F.when(F.col("id") == node, encoding).otherwise(F.col("encoding")))


def swap(nodes: DataFrame, root: int, other: DataFrame) -> DataFrame:
    """The tree with the subtree at root taken out and other put in its place, under the same parent.

    other is a tree of its own (its root has parent -1); its nodes are numbered on from the
    largest id of nodes. Where root is itself a table's node, other becomes that table.
    """
    from pyspark.sql import functions as F

    facts = nodes.agg(F.max("id").alias("last"), F.max(F.when(F.col("id") == root, F.col("parent_id"))).alias("parent")).first()
    if facts["parent"] is None:
        raise ValueError(f"there is no node {root}")
    gone = descendants(nodes, root).select("id").unionByName(nodes.where(F.col("id") == root).select("id"))
    left = nodes.join(gone, "id", "left_anti")
    parent = F.when(F.col("parent_id") == -1, F.lit(facts["parent"])).otherwise(F.col("parent_id") + facts["last"] + 1)
    return left.select(nodes.columns).unionByName(other.select((F.col("id") + facts["last"] + 1).cast("int").alias("id"), parent.cast("int").alias("parent_id"), "encoding", "logical", "name"))


__all__ = ["ENCODING_TAGS", "SCHEMA", "TAGS", "children", "column_nodes", "depths", "descendants", "number", "replace", "swap", "tree"]
