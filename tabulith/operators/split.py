"""Length and byte split of strings and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.operators.position import CHUNK, running

#: Bytes of a chunk, and bytes that a row counts beside its value.
CHUNK_BYTES, ROW_BYTES = 8 << 20, 16
#: Blocks, about, that a chunk is put together from.
BLOCKS_A_CHUNK = 512
#: Values of the blocks that a chunk is cut into on the way to single values.
BLOCKS = (4096, 64)


def lengths(df: DataFrame, value: str, pos: str = "_pos") -> DataFrame:
    """pos and the length of each value in bytes; null has none."""
    return df.select(F.col(pos).alias("_pos"), F.octet_length(value).cast("long").alias("length"))


def offsets(df: DataFrame, value: str, pos: str = "_pos") -> DataFrame:
    """pos, length, and the bytes of all values before it; null counts for nothing."""
    return running(lengths(df, value, pos), "_pos", F.coalesce("length", F.lit(0)), "offset", dense=True)


def encode(df: DataFrame, value: str, pos: str = "_pos", chunk_bytes: int | None = None) -> DataFrame:
    """chunk, first_pos, first, start, starts, lengths, bytes: the values of each chunk of rows end to end.

    A chunk has about chunk_bytes bytes, each row counted with ROW_BYTES more, or one larger
    value, and is what one task holds; no value is ever cut. first is the number of values
    before it, start where its bytes stand in the whole, starts and lengths where each value
    stands in them. Text is joined as
    text, and its bytes are those of the joined text.
    """
    some = df.where(F.col(value).isNotNull()).select(F.col(pos).alias("_pos"), F.col(value).alias("v")).withColumn("n", F.octet_length("v"))
    # where a value would stand if each took ROW_BYTES more
    placed = running(some, "_pos", F.col("n") + ROW_BYTES, "place", dense=True)
    parts = placed.withColumn(CHUNK, F.floor(F.col("place") / (chunk_bytes or CHUNK_BYTES)).cast("long"))
    # Rows are put together in small blocks, and those into chunks: a task holds rows, each an object, of a few blocks at once
    rows = parts.groupBy(CHUNK, F.floor(F.col("place") / F.lit(max(1, (chunk_bytes or CHUNK_BYTES) // BLOCKS_A_CHUNK))).alias("block"))
    blocks = rows.agg(F.array_sort(F.collect_list(F.struct("_pos", "place", "v"))).alias("all"))
    blocks = blocks.select(CHUNK, F.struct(F.col("all")[0]["_pos"].alias("_pos"), F.col("all.place").alias("places"), F.transform("all", lambda x: F.octet_length(x["v"])).alias("lengths"), _joined("all.v").alias("bytes")).alias("block"))
    packed = blocks.groupBy(CHUNK).agg(F.array_sort(F.collect_list("block")).alias("all"))
    packed = packed.select(CHUNK, F.col("all")[0]["_pos"].alias("first_pos"), F.flatten("all.places").alias("places"), F.flatten("all.lengths").alias("lengths"), _joined("all.bytes").cast("binary").alias("bytes"))
    starts = F.transform("places", lambda x, i: (x - F.col("places")[0] - i * ROW_BYTES).cast("int"))
    packed = packed.select(CHUNK, "first_pos", starts.alias("starts"), "lengths", "bytes")
    # from the rows, as the packed chunks would all be made again for their sums
    totals = parts.groupBy(CHUNK).agg(F.count("*").alias("values"), F.sum(F.col("n").cast("long")).alias("n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets_ = totals.select(CHUNK, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("values", "first"), ("n", "start"))])
    return packed.join(F.broadcast(offsets_), CHUNK).select(F.col(CHUNK).alias("chunk"), "first_pos", "first", "start", "starts", "lengths", "bytes")


def _joined(values: str) -> Column:
    """The values of an array end to end, as text; bytes stay as they are, whether they are text or not."""
    return F.array_join(F.col(values).cast("array<string>"), "")


def decode(chunks: DataFrame, as_text: bool = True) -> DataFrame:
    """value_pos (without gaps), value: the inverse of encode(). Values are cut from a chunk's bytes before they become rows.

    Every cut copies all the bytes it is made from, so a chunk is first cut into blocks of
    values, those into smaller ones, and only the smallest into values (see BLOCKS).
    """
    parts = chunks.select("first", "starts", "lengths", "bytes")
    for values in BLOCKS:
        parts = _cut(parts, values)
    # starts are counted from the chunk's first byte
    each = F.transform(F.arrays_zip("starts", "lengths"), lambda x: F.substring(F.col("bytes"), x["starts"] - F.col("starts")[0] + 1, x["lengths"]))
    # outer, as else a filter on the array's size, with all that makes it, is moved below and run for every value
    each = parts.select("first", each.alias("values")).select("first", F.posexplode_outer("values").alias("i", "b")).where("i is not null")
    return each.select((F.col("first") + F.col("i")).cast("long").alias("value_pos"), (F.col("b").cast("string") if as_text else F.col("b")).alias("value"))


def _cut(parts: DataFrame, values: int) -> DataFrame:
    """first, starts, lengths, bytes of blocks of so many values (the last has fewer), from rows of the same columns."""
    n, starts, lengths = F.size("lengths"), F.col("starts"), F.col("lengths")

    def block(i: Column) -> Column:
        last = F.least(i + values, n) - 1
        own = F.substring(F.col("bytes"), starts[i] - starts[0] + 1, starts[last] + lengths[last] - starts[i])
        return F.struct((F.col("first") + i).alias("first"), F.slice(starts, i + 1, values).alias("starts"), F.slice(lengths, i + 1, values).alias("lengths"), own.alias("bytes"))

    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(values)), block)
    return parts.select(blocks.alias("blocks")).select(F.explode_outer("blocks").alias("b")).where("b is not null").select("b.*")


def roundtrip(df: DataFrame, value: str, pos: str = "_pos", chunk_bytes: int | None = None) -> DataFrame:
    return decode(encode(df, value, pos, chunk_bytes))
