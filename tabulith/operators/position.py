"""Positions: rows have an ordinal, `_pos`, from a unique key, and operators that go by it.

A window over all rows in one order would run in one task. Here the key's range is cut
into chunks of about CHUNK_ROWS rows; rows are numbered, and sums run, in each chunk, and
what comes before a chunk is added from a table with one row a chunk. A row's chunk is
found by binary search in the cuts, which are at most MOST_CHUNKS. Where only some
positions are wanted, the chunks' counts tell which range of the key holds them, and the
filter on it goes to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a chunk, about; more rows give more chunks, up to so many, and then larger ones.
CHUNK_ROWS, MOST_CHUNKS = 1_000_000, 10_000
POS, CHUNK = "_pos", "_chunk"


def _numeric(key: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[key]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(key).cast("timestamp"))
    return F.datediff(F.col(key), F.lit("1970-01-01")) if kind == "date" else F.col(key)


def _search(value: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below value, by halving; the cuts are one constant array."""
    if len(cuts) < 16:
        return F.array_size(F.array_compact(F.array(*[F.when(value >= F.lit(c), 1) for c in cuts]))) if cuts else F.lit(0)
    all_ = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<bigint>" if all(isinstance(c, int) for c in cuts) else "array<double>")
    half = lambda x: F.floor((x["a"] + x["z"]) / 2).cast("int")
    step = lambda x, _: F.when(x["a"] == x["z"], x).when(F.get(all_, half(x)) <= value, F.struct((half(x) + 1).alias("a"), x["z"].alias("z"))).otherwise(F.struct(x["a"].alias("a"), half(x).alias("z")))
    turns = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.aggregate(turns, F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("z")), step, lambda x: x["a"])


def cuts_of(df: DataFrame, key: str, rows: int | None = None) -> list[float]:
    """Values of key, as numbers, that cut df into chunks of about `rows` rows; reads the key's column alone."""
    rows, count = rows or CHUNK_ROWS, df.count()
    chunks = min(-(-count // rows), MOST_CHUNKS)
    if chunks <= 1:
        return []
    keys = df.select(_numeric(key, df).alias("k"))
    found = keys.approxQuantile("k", [i / chunks for i in range(1, chunks)], 0.2 / chunks)
    # whole numbers are compared as such, which the scan can do too
    return sorted(set(found if dict(keys.dtypes)["k"] in ("float", "double") or dict(keys.dtypes)["k"].startswith("decimal") else map(int, found)))


def chunked(df: DataFrame, key: str, rows: int | None = None, dense: bool = False, cuts: list[float] | None = None) -> DataFrame:
    """df with `_chunk`, in the order of key (a number, date or timestamp); null keys are in the first.

    Of a dense key (a position or a run's number) no more is to be known. For others the
    rows are counted and quantiles of the key taken, if the cuts are not given.
    """
    if dense:
        return df.withColumn(CHUNK, F.floor(F.col(key) / (rows or CHUNK_ROWS)).cast("int"))
    cuts = cuts_of(df, key, rows) if cuts is None else cuts
    return df.withColumn(CHUNK, F.coalesce(_search(_numeric(key, df), cuts), F.lit(0)))


def _holding(df: DataFrame, key: str, start: int, end: int | None, rows: int | None) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of the chunks that hold positions from start to end, those of all later chunks, and the position of the first.

    One count a chunk reaches the driver; the rows are chosen by ranges of the key. Without
    an end only the chunk that holds the start is among the first, and later ones need no
    number; with one there are no later ones.
    """
    cuts = cuts_of(df, key, rows)
    if not cuts:
        return df, None, 0
    counts = [0] * (len(cuts) + 1)
    for r in chunked(df.select(key), key, cuts=cuts).groupBy(CHUNK).count().collect():
        counts[r[CHUNK]] = r["count"]
    first = before = 0
    while first < len(cuts) and before + counts[first] <= start:
        before += counts[first]
        first += 1
    last, until = first, before + counts[first]
    while end is not None and last < len(cuts) and until < end:
        last += 1
        until += counts[last]
    value = _numeric(key, df)
    held = value >= cuts[first - 1] if first else value.isNotNull() | value.isNull()
    if last < len(cuts):
        held = (value < cuts[last]) & held if first else (value < cuts[last]) | value.isNull()
    rest = df.where(value >= cuts[last]) if end is None and last < len(cuts) else None
    return df.where(held), rest, before


def in_chunk(key: str) -> Window:
    return Window.partitionBy(CHUNK).orderBy(F.col(key).asc_nulls_first())


def before_chunk(totals: DataFrame, column: str, name: str) -> DataFrame:
    """`_chunk` and the sum of column over all chunks before it, under name. totals has one row a chunk."""
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(CHUNK, F.coalesce(F.sum(column).over(before), F.lit(0)).alias(name))


def running(df: DataFrame, key: str, amount: Column, name: str, rows: int | None = None, exclusive: bool = True, dense: bool = False) -> DataFrame:
    """df with the sum of amount over all rows before, in the order of key (and the row itself, if not exclusive)."""
    parts = df if CHUNK in df.columns else chunked(df, key, rows, dense)
    parts = parts.withColumn("_amount", amount)
    until = in_chunk(key).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    offsets = before_chunk(parts.groupBy(CHUNK).agg(F.sum("_amount").alias("_total")), "_total", "_before")
    local = F.coalesce(F.sum("_amount").over(until), F.lit(0))
    # one row a chunk is broadcast
    out = parts.withColumn("_local", local).join(F.broadcast(offsets), CHUNK)
    out = out.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", "_amount")
    return out if CHUNK in df.columns else out.drop(CHUNK)


def with_position(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df with `_pos`, 0 for the smallest key. Equal keys are numbered in no set order."""
    return running(df, key, F.lit(1), POS, rows)


def point(df: DataFrame, at: int, pos: str = POS) -> DataFrame:
    """The row at a position; the filter reaches the files' statistics where pos is stored."""
    return df.where(F.col(pos) == at)


def slice_rows(df: DataFrame, start: int, count: int, pos: str = POS) -> DataFrame:
    return df.where((F.col(pos) >= start) & (F.col(pos) < start + count))


def head(df: DataFrame, count: int, key: str = POS) -> DataFrame:
    return df.orderBy(key).limit(count)


def skip(df: DataFrame, count: int, key: str, rows: int | None = None) -> DataFrame:
    """All rows but the first count in the order of key. With `_pos` as key it is a filter; else only one chunk is numbered."""
    if key == POS:
        return df.where(F.col(POS) >= count)
    held, rest, before = _holding(df, key, count, None, rows)
    left = with_position(held, key, rows).where(F.col(POS) >= count - before).drop(POS)
    return left if rest is None else left.unionByName(rest)


def slice_of(df: DataFrame, key: str, start: int, count: int, rows: int | None = None) -> DataFrame:
    """`_pos` and the columns of count rows from position start on; only the chunks that hold them are read and numbered."""
    held, _, before = _holding(df, key, start, start + count, rows)
    placed = with_position(held, key, rows).withColumn(POS, F.col(POS) + before)
    return slice_rows(placed, start, count)


def zip_rows(left: DataFrame, right: DataFrame, pad: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of two tables side by side by `_pos`; where one is shorter its columns are null, or padded."""
    out = left.join(right, POS, "full_outer")
    if pad is not None:
        out = out.select(POS, *[pad(F.col(c)).alias(c) for c in out.columns if c != POS])
    return out


def pick_random(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(1)


def cursor_state(df: DataFrame, index: int = 0) -> DataFrame:
    """length, index and whether the end is reached."""
    return df.agg(F.count("*").alias("length")).select("length", F.lit(index).cast("long").alias("index"), (F.lit(index) >= F.col("length")).alias("is_at_end"))
