"""Text views of tables: previews and centred headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column, width: int = 12) -> Column:
    """A value as text of exactly `width` characters; null is blank."""
    return F.rpad(F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, width), width, " ")


def preview(df: DataFrame, key: str, count: int = 15, width: int = 12) -> DataFrame:
    """The first `count` rows in the order of key, as cells."""
    return df.orderBy(key).limit(count).select(*[cell(F.col(c), width).alias(c) for c in df.columns])


def centre(text: str, width: int) -> str:
    """text in the middle of width blanks, the odd one on the right; longer text as it is."""
    left = max(0, width - len(text)) // 2
    return (" " * left + text).ljust(width)


def leaves_text(file, table: str, count: int = 15, width: int = 12, line: int | None = None) -> str:
    """The first values of each physical leaf column of a container's table, side by side, and how many each has.

    line: the characters of a printed line; columns that go beyond are left out.
    """
    leaves = [x for column in file.tables[table][1].values() for x in file.leaves(column)]
    leaves = leaves if line is None else leaves[: max(1, line // (width + 4))]
    values = [file.column(x) for x in leaves]
    cut = lambda v: str(v)[:width].ljust(width)
    head = "| " + " | ".join(centre(f"{x.id} ({x.logical})", width) for x in leaves) + " |"
    body = ["| " + " | ".join(cut(v[i]) if i < len(v) else " " * width for v in values) + " |" for i in range(count)]
    foot = "| " + " | ".join(f"[ln: {len(v)}]".ljust(width) for v in values) + " |"
    return "\n".join([f"## {centre(table, width)}", head, "|" + "|".join("-" * (width + 2) for _ in leaves) + "|", *body, foot])


def preview_text(df: DataFrame, name: str, key: str, count: int = 15, width: int = 12, logical: bool = True) -> str:
    """A preview as a printed table with a line of lengths at its end."""
    rows = preview(df, key, count, width).collect()
    total = df.count()
    rule = "|" + "|".join("-" * (width + 2) for _ in df.columns) + "|"
    head = "| " + " | ".join(centre(c, width)[:width] for c in df.columns) + " |"
    body = ["| " + " | ".join(r) + " |" for r in rows]
    foot = "| " + " | ".join(f"[ln: {total}]".ljust(width) for _ in df.columns) + " |"
    return "\n".join([f"## {centre(name, width)}", head, rule, *body, foot])
