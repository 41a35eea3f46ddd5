"""Common-prefix bit-packing of integer columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.types import WIDTHS


def bits_of(logical: str) -> int:
    return 8 * WIDTHS[logical]


def bit_counts(df: DataFrame, value: str, logical: str = "SInt64") -> DataFrame:
    """bit (0 is the highest), ones: in how many values each bit is set. One pass over the column."""
    bits, x = bits_of(logical), F.col(value).cast("long")
    found = df.agg(F.array(*[F.coalesce(F.sum(F.getbit(x, F.lit(bits - 1 - i))), F.lit(0)).cast("long") for i in range(bits)]).alias("a"))
    return found.select(F.posexplode("a").alias("bit", "ones"))


def shared_prefix(same: Column, some: Column, logical: str) -> tuple[Column, Column]:
    """Length, at most bits - 1, and value of the longest prefix of values whose AND is `same` and whose OR is `some`.

    What all values share is where the two agree. Null, for no values, gives null.
    """
    bits = bits_of(logical)
    differ = same.bitwiseXOR(some) if bits == 64 else same.bitwiseXOR(some).bitwiseAND(F.lit(2**bits - 1))
    used = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ)))
    length = F.when(differ.isNotNull(), F.least(F.lit(bits - 1), F.lit(bits) - used)).cast("int")
    low = same if bits == 64 else same.bitwiseAND(F.lit(2**bits - 1))
    return length, F.call_function("shiftrightunsigned", low, F.lit(bits) - length)


def prefix_columns(value: Column, logical: str) -> tuple[Column, Column]:
    """shared_prefix() as aggregates over a column; null values don't count."""
    x = value.cast("long")
    return shared_prefix(F.bit_and(x), F.bit_or(x), logical)


def prefix(df: DataFrame, value: str, logical: str = "SInt64") -> DataFrame:
    """prefix_length, prefix, rows of a column."""
    length, bits = prefix_columns(F.col(value), logical)
    return df.agg(length.alias("prefix_length"), bits.alias("prefix"), F.count(value).alias("rows"))


def residual_of(value: Column, length: int, logical: str) -> Column:
    """What is left of a value without its first `length` bits."""
    width = bits_of(logical) - length
    return value.cast("long") if width >= 64 else value.cast("long").bitwiseAND(F.lit(2**width - 1))


def encode(df: DataFrame, value: str, logical: str = "SInt64", pos: str = "_pos") -> tuple[DataFrame, int, int] | None:
    """pos and residual of each value, prefix length and prefix; None where values share no prefix."""
    meta = prefix(df, value, logical).first()
    if not meta["prefix_length"]:
        return None
    length = meta["prefix_length"]
    return df.select(F.col(pos).alias("_pos"), residual_of(F.col(value), length, logical).alias("residual")), length, meta["prefix"]


def decode(residuals: DataFrame, length: int, head: int, logical: str = "SInt64") -> DataFrame:
    """_pos, value: the prefix put back in front, and the sign restored."""
    bits = bits_of(logical)
    whole = head << (bits - length)
    whole -= 2**64 if whole >= 2**63 else 0
    value = F.col("residual").bitwiseOR(F.lit(whole).cast("long"))
    if logical[0] == "S" and bits < 64:
        value = F.when(value >= 2 ** (bits - 1), value - 2**bits).otherwise(value)
    return residuals.select("_pos", value.alias("value"))


def size_columns(length: Column, rows: Column, logical: str) -> tuple[Column, Column, Column]:
    """Bits of a residual, words and bytes of the packed column."""
    bits = bits_of(logical)
    width = F.lit(bits) - length
    words = F.floor(rows * width / F.lit(bits)).cast("long") + 1
    return width, words, words * WIDTHS[logical]


def size(df: DataFrame, value: str, logical: str = "SInt64") -> DataFrame:
    """residual_bits, words, packed_bytes, plain_bytes of a column."""
    meta = prefix(df, value, logical)
    width, words, packed = size_columns(F.col("prefix_length"), F.col("rows"), logical)
    return meta.select(width.cast("int").alias("residual_bits"), words.alias("words"), packed.alias("packed_bytes"), (F.col("rows") * WIDTHS[logical]).alias("plain_bytes"))
