"""Made-up columns for measurements: random and ordered numbers, identifiers, words, with nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words that text columns are made of.
WORDS = [
    "alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliett", "kilo", "lima", "mike",
    "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango", "uniform", "victor", "whiskey", "xray", "yankee", "zulu",
]


def _value(kind: str, seed: int) -> Column:
    random = F.rand(seed)
    if kind == "int":
        return (random * 2**31).cast("int")
    if kind == "ordered":
        return F.col("_pos").cast("int")
    if kind in ("double", "float"):
        return random.cast(kind)
    if kind == "word":
        return F.element_at(F.array(*map(F.lit, WORDS)), (random * len(WORDS)).cast("int") + 1)
    if kind == "guid":  # from the position, so a task that runs again gives the same
        h = F.md5(F.concat_ws(":", F.lit(seed), F.col("_pos")))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    raise ValueError(kind)


def table(spark: SparkSession, rows: int, columns: dict[str, str], density: float = 1.0, seed: int = 1) -> DataFrame:
    """`_pos` and columns of kinds int, ordered, double, float, word, guid.

    With a density under 1 there are rows / density rows, and each value is there with that
    probability, so that about `rows` values of a column are left.
    """
    base = spark.range(math.ceil(rows / density)).withColumnRenamed("id", "_pos")
    out = [F.col("_pos")]
    for i, (name, kind) in enumerate(columns.items()):
        value = _value(kind, seed + 2 * i)
        out.append((F.when(F.rand(seed + 2 * i + 1) < density, value) if density < 1 else value).alias(name))
    return base.select(*out)


def wide(spark: SparkSession, rows: int = 1000, density: float = 1.0, seed: int = 1) -> DataFrame:
    """A hundred columns: 20 words, 10 random and 10 ordered integers, 20 doubles, 20 identifiers, 20 floats."""
    kinds = [("word", 20), ("int", 10), ("double", 20), ("ordered", 10), ("guid", 20), ("float", 20)]
    return table(spark, rows, {f"{kind}{i}": kind for kind, n in kinds for i in range(n)}, density, seed)
