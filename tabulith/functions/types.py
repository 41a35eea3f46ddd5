"""Logical types of the store: names, widths, Spark types, groups, compatibility, guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The logical types in the order of their tags, with their width in bytes
# (none for values of varying length).
LOGICAL_TYPES = [
    ("SInt8", 1), ("SInt16", 2), ("SInt32", 4), ("SInt64", 8),
    ("UInt8", 1), ("UInt16", 2), ("UInt32", 4), ("UInt64", 8),
    ("Float16", 2), ("Float32", 4), ("Float64", 8),
    ("Blob", None), ("String", None),
]
NAMES = [name for name, _ in LOGICAL_TYPES]
TAGS = {name: tag for tag, name in enumerate(NAMES)}
WIDTHS = dict(LOGICAL_TYPES)
INTEGERS = NAMES[:8]
FLOATS = NAMES[8:11]
NUMERIC = NAMES[:11]
VARYING = NAMES[11:]

#: Spark types that hold a logical type; unsigned ones are one width up.
SPARK_TYPES = dict(
    zip(NAMES, [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0), T.FloatType(), T.FloatType(), T.DoubleType(), T.BinaryType(), T.StringType()], strict=True)
)
_NATURAL = {"tinyint": "SInt8", "smallint": "SInt16", "int": "SInt32", "bigint": "SInt64", "float": "Float32", "double": "Float64", "binary": "Blob", "string": "String"}


def logical_type(field: T.StructField) -> str:
    """The logical type of a field: the one it is marked with, or the natural one of its Spark type.

    Types that the model lacks (dates, booleans, decimals) count as String, which is what
    they become in a binary container. Nested types have none.
    """
    marked = field.metadata.get("logical_type")
    if marked:
        return marked
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"{field.name}: nested columns have no logical type")
    return _NATURAL.get(field.dataType.simpleString(), "String")


def field(name: str, logical: str, nullable: bool = True) -> T.StructField:
    """A field of a logical type, marked so that the widening can be undone."""
    return T.StructField(name, SPARK_TYPES[logical], nullable, {"logical_type": logical})


def group(logical: str) -> str:
    """Types of one group can be read as one another: the same width, and both integers or both of varying length."""
    if logical in VARYING:
        return "varying"
    return f"integer{WIDTHS[logical]}" if logical in INTEGERS else logical


def compatible(a: str, b: str) -> bool:
    return group(a) == group(b)


def _whole(number: int) -> Column:
    """An integer of any size as a literal."""
    return F.lit(str(number)).cast("decimal(38,0)")


def in_range(value: Column, logical: str) -> Column:
    """Whether an integer fits the logical type; null stays null."""
    bits = 8 * WIDTHS[logical]
    low, high = (0, 2**bits - 1) if logical[0] == "U" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    wide = value.cast("decimal(38,0)")
    return wide.between(_whole(low), _whole(high))


def reinterpret(value: Column, to: str) -> Column:
    """The bits of an integer read as the signed or unsigned type `to` of the same width."""
    bits = 8 * WIDTHS[to]
    if bits < 64:
        low = value.cast("long").bitwiseAND(F.lit(2**bits - 1))
        if to[0] == "S":
            low = F.when(low >= 2 ** (bits - 1), low - 2**bits).otherwise(low)
        return low.cast(SPARK_TYPES[to])
    wide, whole = value.cast("decimal(38,0)"), _whole(2**64)
    if to[0] == "U":
        return F.when(wide < 0, wide + whole).otherwise(wide).cast(SPARK_TYPES[to])
    return F.when(wide >= _whole(2**63), wide - whole).otherwise(wide).cast("long")


def types_frame(spark: SparkSession) -> DataFrame:
    """tag, type, width, is_integer, is_float, is_numeric, is_varying; one row a logical type."""
    rows = [(tag, n, w, n in INTEGERS, n in FLOATS, n in NUMERIC, n in VARYING) for tag, (n, w) in enumerate(LOGICAL_TYPES)]
    return spark.createDataFrame(rows, "tag int, type string, width int, is_integer boolean, is_float boolean, is_numeric boolean, is_varying boolean")


def compatibility_frame(spark: SparkSession) -> DataFrame:
    """type, other, compatible for every pair of logical types."""
    return spark.createDataFrame([(a, b, compatible(a, b)) for a in NAMES for b in NAMES], "type string, other string, compatible boolean")


BLANK = r"[ \t\n\x0B\f\r]*"
FLOAT_TEXT = rf"^{BLANK}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{BLANK}$"
INTEGER_TEXT = rf"^{BLANK}[+-]?[0-9]+{BLANK}$"


def guess(text: Column, widening: bool = False) -> Column:
    """An aggregate: the logical type that all texts of a column have.

    Null and empty texts say nothing; without others the type is Blob. A text with a
    point or an exponent is a float, one with a minus signed, other integers unsigned. An
    integer class has the narrowest width that holds all values. Texts that are no
    numbers, integers beyond 64 bits, and a mix of classes give String; with widening, a
    mix becomes the widest class instead: unsigned and signed become signed, and any
    integers with floats become Float64.
    """
    some = F.when(text != "", text)
    dotted = some.rlike("[.eE]")
    is_float = dotted & some.rlike(FLOAT_TEXT)
    number = F.when(~dotted & some.rlike(INTEGER_TEXT), some)
    value = F.regexp_replace(number, r"[^0-9+-]", "").try_cast("decimal(38,0)")
    held = value.between(_whole(-(2**63)), _whole(2**64 - 1))
    kind = (
        F.when(some.isNull(), None)
        .when(is_float, "float")
        .when(~F.coalesce(held, F.lit(False)), "text")
        .when((value < 0) | F.startswith(some, F.lit("-")), "signed")
        .otherwise("unsigned")
    )
    has = lambda k: F.coalesce(F.max(F.when(kind == k, 1)), F.lit(0)) == 1
    least, most = F.min(value), F.max(value)

    def narrowest(prefix: str) -> Column:
        out = F.lit(f"{prefix}64")
        for bits in (32, 16, 8):
            ok = (most <= _whole(2**bits - 1)) if prefix == "UInt" else (least >= _whole(-(2 ** (bits - 1)))) & (most <= _whole(2 ** (bits - 1) - 1))
            out = F.when(ok, f"{prefix}{bits}").otherwise(out)
        return out

    classes = has("float").cast("int") + has("signed").cast("int") + has("unsigned").cast("int")
    mixed = F.lit("String")
    if widening:
        mixed = F.when(has("float"), "Float64").when(most <= 2**63 - 1, narrowest("SInt")).otherwise("String")
    return (
        F.when(has("text"), "String")
        .when(classes == 0, "Blob")
        .when(classes > 1, mixed)
        .when(has("float"), "Float64" if widening else "Float16")
        .when(has("signed"), narrowest("SInt"))
        .otherwise(narrowest("UInt"))
    )
