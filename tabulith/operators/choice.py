"""Block sampling and the choice of an encoding by cost.

An encoding takes an integer, float or byte column to smaller columns (its parts), which
may be encoded again. The cost of a tree is the bytes of its leaves. encode_sample() and
choose() work on a bounded sample in numpy; costs() and choices() compute whole columns'
costs with DataFrame aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulith.functions.types import INTEGERS, NUMERIC, WIDTHS, logical_type
from tabulith.operators import bitpack, nulls
from tabulith.operators.position import CHUNK, POS, chunked, in_chunk, with_position


@dataclass(frozen=True)
class Options:
    """Levels of nested encodings, share of rows in a sample, blocks of it, most rows of a block."""

    levels: int = 2
    share: float = 0.1
    blocks: int = 10
    longest: int = 1024


def block_length(rows: int, options: Options = Options()) -> int | None:
    """Rows of each block of a sample; None where the whole column is taken."""
    if rows * options.share < options.blocks:
        return None
    return min(int(rows * options.share) // options.blocks, options.longest)


def block_sample(df: DataFrame, rows: int, options: Options = Options(), seed: int | None = None, pos: str = POS) -> DataFrame:
    """The rows of equally many contiguous positions from each of `blocks` sections.

    Blocks start at a random place of their section, or with seed None at its first row.
    Rows past the last full section are never taken.
    """
    length = block_length(rows, options)
    if length is None:
        return df
    section = rows // options.blocks
    starts = np.zeros(options.blocks, int) if seed is None else np.random.default_rng(seed).integers(0, max(section - length, 1), options.blocks)
    taken = F.lit(False)
    for i, start in enumerate(starts.tolist()):
        first = i * section + start
        taken = taken | ((F.col(pos) >= first) & (F.col(pos) < first + length))
    return df.where(taken)


@dataclass
class Node:
    """A column of a tree: its encoding (Binary for a leaf), type, rows, bytes if a leaf, and parts."""

    encoding: str
    logical: str
    rows: int
    size: int = 0
    parts: list[Node] = field(default_factory=list)
    about: dict = field(default_factory=dict)

    def total(self) -> int:
        return self.size if not self.parts else sum(p.total() for p in self.parts)

    def describe(self) -> str:
        return self.encoding if not self.parts else f"{self.encoding}({', '.join(p.describe() for p in self.parts)})"


#: What an encoding does to a column of a type: parts as (type, values) and facts about it, or None where it doesn't fit.
Encode = Callable[[str, np.ndarray], tuple[list[tuple[str, np.ndarray]], dict] | None]


def common_prefix(logical: str, values: np.ndarray) -> tuple[int, int]:
    """Length, at most bits - 1, and value of the prefix that all values share."""
    bits = 8 * WIDTHS[logical]
    raw = np.asarray(values).astype(np.int64).view(np.uint64) if logical[0] == "S" else np.asarray(values, np.uint64)
    if bits < 64:
        raw = raw & np.uint64(2**bits - 1)
    if not len(raw):
        return 0, 0
    same, some = int(np.bitwise_and.reduce(raw)), int(np.bitwise_or.reduce(raw))
    length = min(bits - 1, bits - (same ^ some).bit_length())
    return length, same >> (bits - length)


def pack_words(logical: str, values: np.ndarray, length: int) -> np.ndarray:
    """Values without their first `length` bits, end to end from the highest bit, in words of the type; the last word is always there."""
    bits = 8 * WIDTHS[logical]
    width = bits - length
    raw = np.asarray(values).astype(np.int64).view(np.uint64) if logical[0] == "S" else np.asarray(values, np.uint64)
    each = ((raw[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    words = len(raw) * width // bits + 1
    padded = np.zeros(words * bits, np.uint8)
    padded[: len(each)] = each
    octets = np.packbits(padded).reshape(words, bits // 8)
    return octets[:, ::-1].copy().view(f"<u{bits // 8}").ravel()


def unpack_words(logical: str, words: np.ndarray, length: int, prefix: int, rows: int) -> np.ndarray:
    """The inverse of pack_words()."""
    bits = 8 * WIDTHS[logical]
    width = bits - length
    octets = np.ascontiguousarray(words.astype(f"<u{bits // 8}")).view(np.uint8).reshape(-1, bits // 8)[:, ::-1]
    each = np.unpackbits(octets.ravel())[: rows * width].reshape(rows, width).astype(np.uint64)
    weights = np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)
    raw = (each * weights).sum(axis=1, dtype=np.uint64) | np.uint64((prefix << width) & (2**64 - 1))
    return raw.astype(f"<u{bits // 8}").view(f"<{'i' if logical[0] == 'S' else 'u'}{bits // 8}")


def bit_packing(logical: str, values: np.ndarray):
    """Packed words, if all values share a prefix."""
    if logical not in INTEGERS:
        return None
    length, prefix = common_prefix(logical, values)
    if not length:
        return None
    return [(logical, pack_words(logical, values, length))], {"prefix_length": length, "prefix": prefix}


def run_length(logical: str, values: np.ndarray):
    """Values and repeats of adjacent equal values; NaN equals NaN."""
    if logical not in NUMERIC:
        return None
    values = np.asarray(values)
    if not len(values):
        return [(logical, values), ("SInt32", np.zeros(0, np.int32))], {}
    same = values[1:] == values[:-1]
    if values.dtype.kind == "f":
        same |= np.isnan(values[1:]) & np.isnan(values[:-1])
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    return [(logical, values[starts]), ("SInt32", np.diff(np.append(starts, len(values))).astype(np.int32))], {}


#: Encodings in the order in which they are tried; others can be put beside or in place of them.
ENCODINGS: dict[str, Encode] = {"BitPacking": bit_packing, "RunLength": run_length}


def leaf(logical: str, values: np.ndarray) -> Node:
    return Node("Binary", logical, len(values), len(values) * (WIDTHS[logical] or 1))


def pick(logical: str, values: np.ndarray, levels: int, encodings: dict[str, Encode] | None = None) -> Node:
    """The tree of least cost, where the first step must bring the bytes under three quarters of the plain column."""
    best = leaf(logical, values)
    if levels == 0:
        return best
    least = best.total() // 4 * 3
    for name, encode in (ENCODINGS if encodings is None else encodings).items():
        made = encode(logical, values)
        if made is None:
            continue
        parts, about = made
        node = Node(name, logical, len(values), 0, [pick(t, v, levels - 1, encodings) for t, v in parts], about)
        if node.total() < least:
            best, least = node, node.total()
    return best


def leaves(logical: str, values: list) -> list[tuple[str, np.ndarray]]:
    """A column as plain leaves: a bitmap if it has nulls, lengths and bytes if its values vary in length."""
    out = []
    if any(v is None for v in values):
        bits = np.zeros(8 * nulls.bitmap_bytes(len(values)), np.uint8)
        bits[: len(values)] = [v is None for v in values]
        out.append(("UInt8", np.packbits(bits, bitorder="little")))
        values = [v for v in values if v is not None]
    if WIDTHS[logical] is None:
        raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values]
        return [*out, ("SInt32", np.array([len(v) for v in raw], np.int32)), ("UInt8", np.frombuffer(b"".join(raw), np.uint8))]
    kind = {"S": "i", "U": "u", "F": "f"}[logical[0]]
    return [*out, (logical, np.array([int(v) if kind != "f" else v for v in values], f"<{kind}{WIDTHS[logical]}"))]


def sample(values: np.ndarray, options: Options = Options()) -> np.ndarray:
    """The first rows of each of equally many sections of a column, or all of a short one."""
    length = block_length(len(values), options)
    if length is None:
        return values
    section = len(values) // options.blocks
    return np.concatenate([values[i * section : i * section + length] for i in range(options.blocks)])


def choose(df: DataFrame, column: str, key: str, options: Options = Options(), encodings: dict[str, Encode] | None = None, seed: int | None = 0) -> list[Node]:
    """The chosen tree of each leaf of a column, from a sample in the order of key (with seed None the first rows of its sections).

    The sample has at most blocks * longest rows (or blocks / share, where the whole column
    is taken), which is what reaches the driver.
    """
    return choose_all(df, key, [column], options, encodings, seed)[column]


def choose_all(df: DataFrame, key: str, columns: list[str] | None = None, options: Options = Options(), encodings: dict[str, Encode] | None = None, seed: int | None = 0) -> dict[str, list[Node]]:
    """choose() for several columns, all by default, whose rows are placed and sampled once."""
    columns = columns or df.columns
    placed = with_position(df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]), "_key")
    taken = block_sample(placed, df.count(), options, seed).orderBy(POS).drop("_key", POS).toPandas()
    out = {}
    for i, column in enumerate(columns):
        logical = logical_type(df.schema[column])
        values = [None if v is None or v != v and logical not in ("Float16", "Float32", "Float64") else v for v in taken[f"v{i}"].tolist()]
        if logical == "String":
            values = [None if v is None else str(v) for v in values]
        out[column] = [pick(t, v, options.levels, encodings) for t, v in leaves(logical, values)]
    return out


def _as_integer(name: str, kind: T.DataType):
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.octet_length(name) if isinstance(kind, T.StringType) else F.col(name)


def costs(df: DataFrame, key: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """column, part, logical, rows, plain, packed, run_length: whole columns' bytes, one level deep.

    Texts are costed by their lengths, timestamps by their microseconds. packed is null for
    floats and where values share no prefix. All columns are costed in one pass in the
    order of key: what each chunk has (runs, first and last value, AND, OR, count) is one
    row, and runs that go on in the next chunk are counted once.
    """
    names = columns or [c for c in df.columns if c != key]
    logicals = {}
    for c in names:
        kind = df.schema[c].dataType
        logicals[c] = "SInt32" if isinstance(kind, T.StringType) else "SInt64" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else logical_type(df.schema[c])
    values = {c: f"v{i}" for i, c in enumerate(names)}
    parts = chunked(df.select(F.col(key).alias("_key"), *[_as_integer(c, df.schema[c].dataType).alias(v) for c, v in values.items()]), "_key", rows)
    order = in_chunk("_key")
    first = F.row_number().over(order) == 1
    fresh = {v: F.when(first, 1).when(F.col(v).eqNullSafe(F.lag(v).over(order)), 0).otherwise(1) for v in values.values()}
    marked = parts.withColumns({f"{v}_new": x for v, x in fresh.items()})
    facts = []
    for c, v in values.items():
        facts += [F.sum(f"{v}_new").alias(f"{v}_runs"), F.min_by(v, "_key").alias(f"{v}_first"), F.max_by(v, "_key").alias(f"{v}_last"), F.count(v).alias(f"{v}_rows")]
        if logicals[c] in INTEGERS:
            facts += [F.bit_and(F.col(v).cast("long")).alias(f"{v}_and"), F.bit_or(F.col(v).cast("long")).alias(f"{v}_or")]
    by_chunk = Window.orderBy(CHUNK)  # one row a chunk
    chunks = marked.groupBy(CHUNK).agg(*facts)
    goes_on = {f"{v}_on": F.when(F.row_number().over(by_chunk) == 1, 0).otherwise(F.col(f"{v}_first").eqNullSafe(F.lag(f"{v}_last").over(by_chunk)).cast("int")) for v in values.values()}
    chunks = chunks.withColumns(goes_on)
    out = []
    for c, v in values.items():
        width, count = WIDTHS[logicals[c]], F.coalesce(F.sum(f"{v}_rows"), F.lit(0))
        packed = F.lit(None).cast("long")
        if logicals[c] in INTEGERS:
            length, _ = bitpack.shared_prefix(F.bit_and(f"{v}_and"), F.bit_or(f"{v}_or"), logicals[c])
            packed = F.when(length > 0, bitpack.size_columns(length, count, logicals[c])[2])
        found = F.coalesce(F.sum(f"{v}_runs") - F.sum(f"{v}_on"), F.lit(0))
        part = "lengths" if isinstance(df.schema[c].dataType, T.StringType) else "values"
        out.append(F.struct(F.lit(c).alias("column"), F.lit(part).alias("part"), F.lit(logicals[c]).alias("logical"), count.alias("rows"), (count * width).alias("plain"), packed.alias("packed"), (found * (width + 4)).alias("run_length")))
    return chunks.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def choices(costed: DataFrame) -> DataFrame:
    """column, part, encoding, bytes: the cheapest of each row of costs() that is under three quarters of plain, or plain."""
    limit = F.floor(F.col("plain") / 4).cast("long") * 3
    packed = F.when(F.col("packed") < limit, F.col("packed"))
    runs_ = F.when(F.col("run_length") < F.coalesce(packed, limit), F.col("run_length"))
    encoding = F.when(runs_.isNotNull(), "RunLength").when(packed.isNotNull(), "BitPacking").otherwise("Binary")
    return costed.select("column", "part", encoding.alias("encoding"), F.coalesce(runs_, packed, F.col("plain")).alias("bytes"))
