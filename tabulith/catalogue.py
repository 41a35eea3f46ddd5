"""The registered queries of the library and, beside each, SQL for another engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import cli
from tabulith.functions import types
from tabulith.operators import bitpack, choice, describe, nulls, position, runs, split
from tabulith.plans import tree
from tabulith.sources import container, ingest, store, synthetic, text
from tabulith.streaming import capture as streaming

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return position.with_position(_table(spark, sf, "orders").select("o_orderkey", *columns), "o_orderkey")


# --- scans and positions -------------------------------------------------------------

POSITIONS = "WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders) "


@_query("SELECT * FROM orders")
def scan_full(spark, sf):
    return _table(spark, sf, "orders")


@_query("SELECT o_totalprice FROM orders")
def project_column(spark, sf):
    return _table(spark, sf, "orders").select("o_totalprice")


@_query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def head_n(spark, sf):
    return position.head(_table(spark, sf, "orders"), 100, "o_orderkey")


@_query("SELECT * FROM orders ORDER BY o_orderkey OFFSET 1000")
def skip_n(spark, sf):
    return position.skip(_table(spark, sf, "orders"), 1000, "o_orderkey")


@_query(POSITIONS + "SELECT CAST(_pos AS BIGINT) AS _pos, o_orderkey, o_totalprice FROM p WHERE _pos >= 500 AND _pos < 750")
def slice_range(spark, sf):
    return position.slice_of(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 250).select("_pos", "o_orderkey", "o_totalprice")


@_query(POSITIONS + "SELECT CAST(_pos AS BIGINT) AS _pos, o_orderkey, o_totalprice FROM p WHERE _pos = 1234")
def point_lookup(spark, sf):
    return position.slice_of(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1234, 1).select("_pos", "o_orderkey", "o_totalprice")


@_query("SELECT CAST(count(*) AS BIGINT) AS length, CAST(1000 AS BIGINT) AS index, 1000 >= count(*) AS is_at_end FROM orders")
def cursor_state(spark, sf):
    return position.cursor_state(_table(spark, sf, "orders"), 1000)


@_query(
    """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, o_orderpriority FROM orders),
    c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _pos, c_name FROM customer)
    SELECT CAST(coalesce(o._pos, c._pos) AS BIGINT) AS _pos, coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(c_name, '') AS c_name
    FROM o FULL OUTER JOIN c ON o._pos = c._pos"""
)
def ragged_zip(spark, sf):
    left = _orders(spark, sf, "o_orderpriority").select("_pos", "o_orderpriority")
    right = position.with_position(_table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("_pos", "c_name")
    return position.zip_rows(left, right, lambda c: F.coalesce(c, F.lit("")))


# --- catalogue -----------------------------------------------------------------------


def _all(spark, sf):
    return {n: _table(spark, sf, n) for n in TABLES}


@_query(" UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS rows FROM {n}" for n in TABLES))
def table_lengths(spark, sf):
    return store.lengths_frame(_all(spark, sf))


_LISTED = ", ".join(f"'{n}'" for n in TABLES)


@_query(f"SELECT table_name AS name, CAST(count(*) AS BIGINT) AS columns FROM information_schema.columns WHERE table_name IN ({_LISTED}) GROUP BY table_name")
def catalog_tables(spark, sf):
    return store.tables_frame(spark, _all(spark, sf))


@_query(
    f"""SELECT table_name AS "table", CAST(ordinal_position - min(ordinal_position) OVER (PARTITION BY table_name) AS BIGINT) AS ordinal, column_name AS "column",
    CASE data_type WHEN 'INTEGER' THEN 'SInt32' WHEN 'BIGINT' THEN 'SInt64' WHEN 'DOUBLE' THEN 'Float64' ELSE 'String' END AS logical
    FROM information_schema.columns WHERE table_name IN ({_LISTED})"""
)
def catalog_columns(spark, sf):
    return store.columns_frame(spark, _all(spark, sf))


@_query(
    """WITH RECURSIVE t(id, parent_id, encoding, logical, name) AS (VALUES
    (0, -1, 'Table', 'UInt8', 'orders'), (1, 0, 'Binary', 'SInt64', 'o_orderkey'), (2, 0, 'Binary', 'SInt64', 'o_custkey'),
    (3, 0, 'Split', 'String', 'o_orderstatus'), (4, 3, 'Binary', 'SInt32', 'lengths'), (5, 3, 'Binary', 'UInt8', 'bytes'),
    (6, 0, 'Binary', 'Float64', 'o_totalprice'),
    (7, 0, 'Split', 'String', 'o_orderdate'), (8, 7, 'Binary', 'SInt32', 'lengths'), (9, 7, 'Binary', 'UInt8', 'bytes'),
    (10, 0, 'Split', 'String', 'o_orderpriority'), (11, 10, 'Binary', 'SInt32', 'lengths'), (12, 10, 'Binary', 'UInt8', 'bytes')),
    r AS (SELECT *, 0 AS depth FROM t WHERE parent_id = -1 UNION ALL SELECT t.*, r.depth + 1 FROM t JOIN r ON t.parent_id = r.id)
    SELECT CAST(id AS INTEGER) AS id, CAST(parent_id AS INTEGER) AS parent_id, encoding, logical, name, CAST(depth AS INTEGER) AS depth FROM r"""
)
def encoding_tree(spark, sf):
    return tree.depths(tree.tree(spark, {"orders": _table(spark, sf, "orders")}))


# --- run lengths ---------------------------------------------------------------------

RUNS = """WITH x AS (SELECT {k} AS k, {v} AS v, lag({v}) OVER (ORDER BY {k}) AS p, row_number() OVER (ORDER BY {k}) AS n FROM {t}),
y AS (SELECT k, v, sum(CASE WHEN n > 1 AND v IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM x),
r AS (SELECT CAST(run AS BIGINT) AS run, min(v) AS value, CAST(count(*) AS BIGINT) AS repeats FROM y GROUP BY run) """
STATUS_RUNS = RUNS.format(k="o_orderkey", v="o_orderstatus", t="orders")
EVENT_RUNS = RUNS.format(k="event_id", v="event_type", t="events")
SOME_NULL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END"


def _status_runs(spark, sf):
    return runs.encode(_table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")


@_query(STATUS_RUNS + "SELECT run, value, repeats FROM r")
def rle_encode(spark, sf):
    return _status_runs(spark, sf)


@_query(RUNS.format(k="o_orderkey", v="(CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_orderstatus END)", t="orders") + "SELECT run, value, repeats FROM r")
def rle_encode_nulls(spark, sf):
    df = _table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_orderstatus END").alias("v"))
    return runs.encode(df, "o_orderkey", "v")


@_query(EVENT_RUNS + "SELECT CAST(count(*) AS BIGINT) AS runs, CAST(sum(repeats) AS BIGINT) AS rows, max(repeats) AS longest, min(repeats) AS shortest FROM r")
def rle_stats(spark, sf):
    return runs.stats(runs.encode(_table(spark, sf, "events"), "event_id", "event_type"))


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, o_orderstatus AS value FROM orders")
def rle_roundtrip(spark, sf):
    return runs.decode(_status_runs(spark, sf))


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, o_orderstatus AS value FROM orders")
def rle_point_lookup(spark, sf):
    """Every position looked up in the runs, and one past the end, which has no row."""
    rows = _table(spark, sf, "orders").count()
    return runs.lookup(_status_runs(spark, sf), spark.range(rows + 1).withColumnRenamed("id", "_pos"))


@_query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def rle_sum(spark, sf):
    found = runs.total(runs.encode(_table(spark, sf, "orders"), "o_orderkey", "o_custkey"))
    return found.select(F.col("total").cast("long").alias("total"))


# --- bit packing ---------------------------------------------------------------------

PREFIX = """WITH a AS (SELECT bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, count(*) AS n FROM orders),
b AS (SELECT *, least(63, 64 - CASE WHEN xor(a, o) = 0 THEN 0 ELSE length(bin(xor(a, o))) END) AS w FROM a) """


@_query("SELECT CAST(i AS INTEGER) AS bit, CAST(sum((o_custkey >> (63 - i)) & 1) AS BIGINT) AS ones FROM orders, range(64) t(i) GROUP BY i")
def bit_counts(spark, sf):
    return bitpack.bit_counts(_table(spark, sf, "orders"), "o_custkey")


@_query(PREFIX + "SELECT CAST(w AS INTEGER) AS prefix_length, CAST(a >> (64 - w) AS BIGINT) AS prefix, CAST(n AS BIGINT) AS rows FROM b")
def bitpack_prefix(spark, sf):
    return bitpack.prefix(_table(spark, sf, "orders"), "o_custkey")


@_query(PREFIX + "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, o_custkey & ((CAST(1 AS BIGINT) << (64 - w)) - 1) AS residual FROM orders, b")
def bitpack_residual(spark, sf):
    return bitpack.encode(_orders(spark, sf, "o_custkey"), "o_custkey")[0]


@_query(
    PREFIX
    + """SELECT CAST(64 - w AS INTEGER) AS residual_bits, CAST((n * (64 - w)) // 64 + 1 AS BIGINT) AS words,
    CAST(((n * (64 - w)) // 64 + 1) * 8 AS BIGINT) AS packed_bytes, CAST(n * 8 AS BIGINT) AS plain_bytes FROM b"""
)
def bitpack_size(spark, sf):
    return bitpack.size(_table(spark, sf, "orders"), "o_custkey")


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, o_custkey AS value FROM orders")
def bitpack_roundtrip(spark, sf):
    residuals, length, head = bitpack.encode(_orders(spark, sf, "o_custkey"), "o_custkey")
    return bitpack.decode(residuals, length, head)


# --- nulls ---------------------------------------------------------------------------


def _with_nulls(spark, sf):
    return _orders(spark, sf, "o_custkey").select("_pos", F.expr(SOME_NULL).alias("v"))


NULLS = f"WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, {SOME_NULL} AS v FROM orders) "


@_query(NULLS + "SELECT CAST(_pos // 8 AS BIGINT) AS byte_index, CAST(sum(CASE WHEN v IS NULL THEN 1 << CAST(_pos % 8 AS INTEGER) ELSE 0 END) AS BIGINT) AS bits FROM p GROUP BY _pos // 8")
def null_bitmap(spark, sf):
    return nulls.bitmap(_with_nulls(spark, sf), "v")


@_query(NULLS + "SELECT CAST(row_number() OVER (ORDER BY _pos) - 1 AS BIGINT) AS dense_pos, v AS value FROM p WHERE v IS NOT NULL")
def null_dense_values(spark, sf):
    return nulls.dense(_with_nulls(spark, sf), "v")


@_query(NULLS + "SELECT CAST(_pos AS BIGINT) AS _pos, v AS value FROM p")
def null_roundtrip(spark, sf):
    df = _with_nulls(spark, sf)
    return nulls.merge(nulls.bitmap(df, "v"), nulls.dense(df, "v"), df.count())


# --- lengths and bytes ---------------------------------------------------------------


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS length FROM orders")
def split_lengths(spark, sf):
    return split.lengths(_orders(spark, sf, "o_orderpriority"), "o_orderpriority")


@_query(
    """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, octet_length(encode(o_orderpriority)) AS n FROM orders)
    SELECT CAST(_pos AS BIGINT) AS _pos, CAST(n AS BIGINT) AS length, CAST(sum(n) OVER (ORDER BY _pos ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS "offset" FROM p"""
)
def split_offsets(spark, sf):
    return split.offsets(_orders(spark, sf, "o_orderpriority"), "o_orderpriority")


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS value_pos, o_orderpriority AS value FROM orders")
def split_roundtrip(spark, sf):
    return split.roundtrip(_orders(spark, sf, "o_orderpriority"), "o_orderpriority")


# --- sampling and choice -------------------------------------------------------------


@_query(
    POSITIONS
    + """, n AS (SELECT count(*) AS n FROM orders), l AS (SELECT n // 10 AS section, least(CAST(floor(n * 0.1) AS BIGINT) // 10, 1024) AS len FROM n)
    SELECT CAST(_pos AS BIGINT) AS _pos, o_orderkey, o_custkey FROM p, l WHERE _pos < section * 10 AND _pos % section < len"""
)
def block_sample(spark, sf):
    df = _orders(spark, sf, "o_custkey")
    return choice.block_sample(df, df.count()).select("_pos", "o_orderkey", "o_custkey")


def _cost_sql(column: str, value: str, part: str, logical: str, width: int, integer: bool) -> str:
    bits = 8 * width
    # of a 32-bit value the 64-bit form has 32 sign bits more in front
    packed = "CAST(NULL AS BIGINT)"
    if integer:
        used = f"CASE WHEN xor(bit_and(CAST({value} AS BIGINT)), bit_or(CAST({value} AS BIGINT))) = 0 THEN 0 ELSE length(bin(xor(bit_and(CAST({value} AS BIGINT)), bit_or(CAST({value} AS BIGINT))))) END"
        length = f"least({bits - 1}, {bits} - least({bits}, {used}))"
        packed = f"CASE WHEN {length} > 0 THEN CAST(((count(*) * ({bits} - {length})) // {bits} + 1) * {width} AS BIGINT) END"
    order = "o_orderkey"
    changes = f"SELECT sum(CASE WHEN n > 1 AND v IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) FROM (SELECT {value} AS v, lag({value}) OVER (ORDER BY {order}) AS p, row_number() OVER (ORDER BY {order}) AS n FROM orders)"
    return f"""SELECT '{column}' AS "column", '{part}' AS part, '{logical}' AS logical, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) * {width} AS BIGINT) AS plain,
    {packed} AS packed, CAST(({changes}) * {width + 4} AS BIGINT) AS run_length FROM orders"""


COSTS = " UNION ALL ".join(
    [
        _cost_sql("o_custkey", "o_custkey", "values", "SInt64", 8, True),
        _cost_sql("o_orderstatus", "octet_length(encode(o_orderstatus))", "lengths", "SInt32", 4, True),
        _cost_sql("o_totalprice", "o_totalprice", "values", "Float64", 8, False),
        _cost_sql("o_orderdate", "epoch_us(o_orderdate)", "values", "SInt64", 8, True),
        _cost_sql("o_orderpriority", "octet_length(encode(o_orderpriority))", "lengths", "SInt32", 4, True),
    ]
)


@_query(COSTS)
def encoding_cost(spark, sf):
    return choice.costs(_table(spark, sf, "orders"), "o_orderkey")


@_query(
    f"""WITH c AS ({COSTS}), l AS (SELECT *, (plain // 4) * 3 AS top FROM c), k AS (SELECT *, CASE WHEN packed < top THEN packed END AS k FROM l),
    r AS (SELECT *, CASE WHEN run_length < coalesce(k, top) THEN run_length END AS r FROM k)
    SELECT "column", part, CASE WHEN r IS NOT NULL THEN 'RunLength' WHEN k IS NOT NULL THEN 'BitPacking' ELSE 'Binary' END AS encoding, coalesce(r, k, plain) AS bytes FROM r"""
)
def encoding_choice(spark, sf):
    return choice.choices(choice.costs(_table(spark, sf, "orders"), "o_orderkey"))


# --- types ---------------------------------------------------------------------------

_GUESSED = [("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey"), ("orders", "o_custkey"), ("part", "p_size"), ("labels", "toxic"), ("documents", "lang")]


def _guess_sql(table: str, column: str) -> str:
    t = f"CAST({column} AS VARCHAR)"
    digits = f"regexp_full_match({t}, '[+-]?[0-9]+')"
    value = f"CASE WHEN {digits} THEN CAST({t} AS HUGEINT) END"
    return f"""SELECT '{column}' AS "column", CASE WHEN bool_or(NOT {digits}) THEN 'String' WHEN count(nullif({t}, '')) = 0 THEN 'Blob'
    WHEN min({value}) < 0 AND max({value}) >= 0 THEN 'String'
    WHEN min({value}) < 0 THEN CASE WHEN min({value}) >= -128 THEN 'SInt8' WHEN min({value}) >= -32768 THEN 'SInt16' WHEN min({value}) >= -2147483648 THEN 'SInt32' ELSE 'SInt64' END
    ELSE CASE WHEN max({value}) <= 255 THEN 'UInt8' WHEN max({value}) <= 65535 THEN 'UInt16' WHEN max({value}) <= 4294967295 THEN 'UInt32' ELSE 'UInt64' END END AS guess FROM {table}"""


@_query(" UNION ALL ".join(_guess_sql(t, c) for t, c in _GUESSED))
def type_guess(spark, sf):
    out = None
    for table, column in _GUESSED:
        row = _table(spark, sf, table).agg(types.guess(F.col(column).cast("string")).alias("guess")).select(F.lit(column).alias("column"), "guess")
        out = row if out is None else out.unionByName(row)
    return out


# Tags, names and widths of the logical types, for the other engine.
_TYPE_ROWS = """(0, 'SInt8', 1), (1, 'SInt16', 2), (2, 'SInt32', 4), (3, 'SInt64', 8), (4, 'UInt8', 1), (5, 'UInt16', 2), (6, 'UInt32', 4), (7, 'UInt64', 8),
    (8, 'Float16', 2), (9, 'Float32', 4), (10, 'Float64', 8), (11, 'Blob', NULL), (12, 'String', NULL)"""
_TYPE_GROUP = "CASE WHEN {a}.width IS NULL THEN 'v' WHEN {a}.tag < 8 THEN 'i' || {a}.width ELSE {a}.type END"


@_query(
    f"""WITH t(tag, type, width) AS (VALUES {_TYPE_ROWS}) SELECT a.type AS type, b.type AS other,
    {_TYPE_GROUP.format(a="a")} = {_TYPE_GROUP.format(a="b")} AS compatible FROM t a, t b"""
)
def type_compat(spark, sf):
    return types.compatibility_frame(spark)


@_query(
    f"""WITH t(tag, type, width) AS (VALUES {_TYPE_ROWS}) SELECT CAST(tag AS INTEGER) AS tag, type, CAST(width AS INTEGER) AS width,
    tag < 8 AS is_integer, tag BETWEEN 8 AND 10 AS is_float, tag < 11 AS is_numeric, tag >= 11 AS is_varying FROM t"""
)
def type_sizes(spark, sf):
    return types.types_frame(spark)


@_query(
    """SELECT o_orderkey, CAST((1000 - o_custkey) & 255 AS SMALLINT) AS u8, CAST((1000 - o_custkey) & 65535 AS INTEGER) AS u16,
    CAST((1000 - o_custkey) & 4294967295 AS BIGINT) AS u32,
    CAST(CASE WHEN ((o_custkey * 7) & 255) >= 128 THEN ((o_custkey * 7) & 255) - 256 ELSE (o_custkey * 7) & 255 END AS TINYINT) AS s8 FROM orders"""
)
def reinterpret_unsigned(spark, sf):
    v = 1000 - F.col("o_custkey")
    return _table(spark, sf, "orders").select("o_orderkey", types.reinterpret(v, "UInt8").alias("u8"), types.reinterpret(v, "UInt16").alias("u16"), types.reinterpret(v, "UInt32").alias("u32"), types.reinterpret(F.col("o_custkey") * 7, "SInt8").alias("s8"))


# --- text ----------------------------------------------------------------------------


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, coalesce(n_name, '') AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_all_string_scan(spark, sf):
    """A CSV file read with every column as text."""
    path = _shared(spark, "nation-csv")
    _table(spark, sf, "nation").write.option("header", True).csv(path)
    return text.read_csv(spark, path)


_CELL = "CASE WHEN {c} LIKE '%,%' THEN '\"' || {c} || '\"' ELSE {c} END"
_NATION_LINES = f"""SELECT CAST(0 AS BIGINT) AS line_no, 'n_nationkey,n_name,n_regionkey' AS line UNION ALL
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT), CAST(n_nationkey AS VARCHAR) || ',' || {_CELL.format(c="n_name")} || ',' || CAST(n_regionkey AS VARCHAR) FROM nation"""
_REGION_LINES = f"""SELECT CAST(0 AS BIGINT) AS line_no, 'r_regionkey,r_name' AS line UNION ALL
SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT), CAST(r_regionkey AS VARCHAR) || ',' || {_CELL.format(c="r_name")} FROM region"""


@_query(_NATION_LINES)
def csv_lines(spark, sf):
    return text.csv_lines(_table(spark, sf, "nation"), "n_nationkey")


@_query(
    f"""SELECT CAST(0 AS INTEGER) AS table_no, * FROM ({_REGION_LINES}) UNION ALL SELECT 0, -1, 'region'
    UNION ALL SELECT CAST(1 AS INTEGER), * FROM ({_NATION_LINES}) UNION ALL SELECT 1, -1, 'nation'"""
)
def csv_multi_table_lines(spark, sf):
    return text.csv_tables({"region": (_table(spark, sf, "region"), "r_regionkey"), "nation": (_table(spark, sf, "nation"), "n_nationkey")})


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tbl_parse(spark, sf):
    schema = text.parse_ddl("CREATE TABLE nation ( n_nationkey INTEGER not null,\n n_name CHAR(25) not null,\n n_regionkey INTEGER not null);")["nation"]
    return text.parse_tbl(text.tbl_lines(_table(spark, sf, "nation")), schema)


@_query(
    """SELECT r_regionkey AS key, r_name AS name, CAST(NULL AS INTEGER) AS region FROM region
    UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation"""
)
def schema_union(spark, sf):
    region = _table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    nation = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return store.union_of([region, nation])


@_query(
    """SELECT rpad(substr(CAST(o_orderkey AS VARCHAR), 1, 12), 12, ' ') AS o_orderkey, rpad(substr(CAST(o_custkey AS VARCHAR), 1, 12), 12, ' ') AS o_custkey,
    rpad(substr(o_orderstatus, 1, 12), 12, ' ') AS o_orderstatus, rpad(substr(o_orderpriority, 1, 12), 12, ' ') AS o_orderpriority
    FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 15)"""
)
def describe_preview(spark, sf):
    return describe.preview(_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS _pos, * FROM supplier")
def container_roundtrip(spark, sf):
    """A table written to a compressed binary container and read back by the data source."""
    container.register(spark)
    path = _shared(spark, "suppliers")
    container.export({"supplier": (_table(spark, sf, "supplier"), "s_suppkey")}, path)
    return spark.read.format("container").option("table", "supplier").load(path)


@_query(
    """SELECT * FROM (VALUES (0, -1, 'Table', 'UInt8'), (1, 0, 'Binary', 'SInt32'), (2, 0, 'Split', 'String'), (3, 2, 'Binary', 'SInt32'),
    (4, 2, 'Binary', 'UInt8'), (5, 0, 'Binary', 'SInt32')) AS t(id, parent_id, encoding, logical)"""
)
def container_nodes(spark, sf):
    """The metadata rows of a plain container."""
    path = _shared(spark, "nations")
    container.export({"nation": (_table(spark, sf, "nation"), "n_nationkey")}, path, compress=False)
    return container.nodes_frame(spark, container.read_file(path)).select("id", "parent_id", "encoding", "logical")


@_query("SELECT * FROM orders UNION ALL SELECT * FROM orders")
def store_append(spark, sf):
    """A table of a store, written and added to."""
    kept, orders = store.Store(spark, _shared(spark, "store")), _table(spark, sf, "orders")
    kept.write("run 1/orders", orders, sort_by="o_orderkey")
    kept.write("run 1/orders", orders, "append")
    return kept.table("run 1/orders")


#: A table of 5,000 rows whose columns call for different encodings.
def _made(spark: SparkSession) -> DataFrame:
    k = F.col("k")
    return spark.range(5000).withColumnRenamed("id", "k").select(
        "k", F.lit(7).cast("long").alias("constant"), (F.floor(k / 250) * 1000003).cast("long").alias("steps"), (F.pmod(k * 37, F.lit(64)) + 1000).cast("int").alias("narrow"), (k * 0.5).alias("half"),
        F.when(k < 2600, "yes").otherwise("no").alias("word"),
    )


# The sample has 10 blocks of 50 rows, the first of each 500. k: values below 4,550 need 13 of 64 bits, 500 * 13 / 64 + 1 = 102 words.
# narrow: 1,000 to 1,063 share 21 of 32 bits, 500 * 11 / 32 + 1 = 172 words. half: plain.
@_query(
    """SELECT * FROM (VALUES ('k', CAST(0 AS INTEGER), 'BitPacking(Binary)', CAST(816 AS BIGINT)), ('narrow', 0, 'BitPacking(Binary)', 688), ('half', 0, 'Binary', 4000))
    AS t("column", part, tree, sample_bytes)"""
)
def encoding_choice_nested(spark, sf):
    """Trees chosen from samples of the first rows of ten sections, two levels deep."""
    made = _made(spark)
    rows = [(c, i, n.describe(), n.total()) for c, trees in choice.choose_all(made, "k", ["k", "narrow", "half"], seed=None).items() for i, n in enumerate(trees)]
    return spark.createDataFrame(rows, "column string, part int, tree string, sample_bytes long")


@_query("SELECT CAST(1 AS BIGINT) AS picked, count(*) > 1 AS there_are_others, CAST(10 AS BIGINT) AS rows_with_its_values FROM orders")
def pick_random(spark, sf):
    """Ten picks of a row: each is one row of orders with all its values; with so many rows they are not all one."""
    orders = _table(spark, sf, "orders")
    picks = [position.pick_random(orders, seed).withColumn("seed", F.lit(seed)) for seed in range(10)]
    all_picks = picks[0]
    for p in picks[1:]:
        all_picks = all_picks.unionByName(p)
    a_seed = all_picks.groupBy("seed").count().agg(F.max("count").alias("picked"))
    found = all_picks.join(orders, orders.columns).agg(F.count("*").alias("rows_with_its_values"), (F.count_distinct("o_orderkey") > 1).alias("there_are_others"))
    return a_seed.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k").drop("k")


# --- capture -------------------------------------------------------------------------


@_query(
    """SELECT 'event-' || event_id AS id, 'user-' || user_id AS parent, event_type AS name FROM events
    UNION ALL SELECT 'plan', NULL, 'all events'"""
)
def ancestry_table(spark, sf):
    events = _table(spark, sf, "events")
    return streaming.ancestry(events, F.concat(F.lit("event-"), "event_id"), F.concat(F.lit("user-"), "user_id"), F.col("event_type"), ("plan", "all events"))


@_query(
    """SELECT CAST(event_id AS VARCHAR) AS id, 'run/user_id' AS names, CAST(11 AS INTEGER) AS type, CAST(user_id AS VARCHAR) AS value FROM events
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'run/event_type', 18, event_type FROM events
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'props', 18, props FROM events"""
)
def params_unpivot(spark, sf):
    events = _table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return streaming.parameters(events, "event_id", {"user_id": "run", "event_type": "run"})


@_query("SELECT * FROM events")
def stream_result_capture(spark, sf):
    """All events published as a stream and captured to a store; the captured table."""
    at = _shared(spark, "capture")
    kept = store.Store(spark, f"{at}/store")
    stream = spark.readStream.schema(_table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    streaming.capture(stream, kept, "run/events", f"{at}/state").awaitTermination()
    return kept.table("run/events").drop("_batch")


@_query()
def synthetic_sparsity(spark, sf):
    return synthetic.wide(spark, 1000, 0.8)


@_query("SELECT CAST(1250 AS BIGINT) AS rows, CAST(100 AS BIGINT) AS columns")
def synthetic_shape(spark, sf):
    """Rows and columns of the made-up wide table: 1,000 full rows at a sparsity of 0.8."""
    df = synthetic.wide(spark, 1000, 0.8)
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len([c for c in df.columns if c != "_pos"])).cast("long").alias("columns"))


# --- in and out ----------------------------------------------------------------------


@_query("SELECT n_nationkey, n_name, n_regionkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS _pos FROM nation")
def ingest_arrays(spark, sf):
    """A table from arrays and lists of values."""
    rows = _table(spark, sf, "nation").orderBy("n_nationkey").toPandas()
    return ingest.from_arrays(spark, {"n_nationkey": rows["n_nationkey"].to_numpy(), "n_name": rows["n_name"].tolist(), "n_regionkey": rows["n_regionkey"].to_numpy()})


@_query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'one'), (1, 2, NULL), (2, NULL, 'three')) AS t(_pos, number, word)")
def ingest_builder(spark, sf):
    """A table that grows value by value."""
    built = ingest.Builder().append("number", 1).append("word", "one").append("number", 2).extend("word", [None, "three"]).append("number", None)
    return built.build(spark)


@_query("SELECT r_regionkey, r_name, octet_length(encode(r_name)) AS bytes FROM region")
def ingest_streamed_cells(spark, sf):
    """Values of bytes that come in parts, through a stream each."""
    built = ingest.Builder()
    for r in _table(spark, sf, "region").orderBy("r_regionkey").collect():
        with built.append("r_regionkey", r["r_regionkey"]).cell("name") as stream:
            for letter in r["r_name"]:
                stream.write(letter.encode())
    out = built.build(spark)
    return out.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("name").cast("string").alias("r_name"), F.octet_length("name").cast("long").alias("bytes"))


@_query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS at, r_name AS value FROM region")
def inline_values(spark, sf):
    """Length-prefixed values in one run of bytes, peeked at and read from the last to the first."""
    names = [r["r_name"].encode() for r in _table(spark, sf, "region").orderBy("r_regionkey").collect()]
    cursor = container.Cursor(b"".join(len(n).to_bytes(4, "little") + n for n in names))
    places = cursor.places()
    found = [(i, cursor.seek(places[i]).peek_blob().decode()) for i in reversed(range(len(places)))]
    return spark.createDataFrame(found, "at int, value string")


@_query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _pos, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def container_distributed(spark, sf):
    """A table written as containers task by task, without the driver, and read back as one."""
    container.register(spark)
    path = _shared(spark, "orders-containers")
    orders = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.format("container").option("table", "orders").option("rows", 2000).mode("overwrite").save(path)
    return spark.read.format("container").option("table", "orders").load(path)


@_query("SELECT k AS _pos, k, CAST(7 AS BIGINT) AS constant, CAST(k // 250 * 1000003 AS BIGINT) AS steps, CAST(k * 37 % 64 + 1000 AS INTEGER) AS narrow, k * 0.5::DOUBLE AS half, CASE WHEN k < 2600 THEN 'yes' ELSE 'no' END AS word FROM range(5000) t(k)")
def encoding_replay(spark, sf):
    """A container whose columns are encoded whole by trees that were chosen from samples, read back."""
    container.register(spark)
    path = _shared(spark, "made")
    container.export({"made": (_made(spark), "k")}, path)
    return spark.read.format("container").option("table", "made").load(path)


# k has 5,000 values below 8,192, constant one run, steps twenty, narrow 64 values, half no encoding.
@_query(
    """SELECT * FROM (VALUES ('constant', 'RunLength'), ('half', 'Binary'), ('k', 'BitPacking'), ('narrow', 'BitPacking'), ('steps', 'RunLength'), ('word', 'Split')) AS t("column", encoding)"""
)
def encoding_replay_trees(spark, sf):
    """The outermost encoding of each column of that container."""
    path = _shared(spark, "made-trees")
    container.export({"made": (_made(spark), "k")}, path)
    columns = container.read_file(path).tables["made"][1]
    return spark.createDataFrame([(n, c.encoding) for n, c in columns.items()], "column string, encoding string")


@_query("SELECT * FROM (VALUES ('halved(Binary)', CAST(20000 AS BIGINT))) AS t(tree, bytes)")
def encoding_custom(spark, sf):
    """An own encoding, which keeps one of each pair of equal numbers, chosen beside the others."""
    halved = lambda kind, v: ([(kind, v[::2])], {}) if len(v) % 2 == 0 and (v[::2] == v[1::2]).all() else None
    values = np.repeat(np.arange(2500, dtype=np.int64) * 2**50 - 2**60, 2)
    tree = choice.pick("SInt64", values, 1, {"halved": halved})
    return spark.createDataFrame([(tree.describe(), tree.total())], "tree string, bytes long")


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def convert_to_csv(spark, sf):
    """A Parquet table converted to a CSV file by the command's function, and that read."""
    target = _shared(spark, "converted")
    cli.write_tables({"nation": (_table(spark, sf, "nation"), "n_nationkey")}, f"{target}.csv", "csv")
    return text.read_csv(spark, f"{target}.csv")


def _through(kind: str):
    def run(spark, sf):
        target = _shared(spark, f"as-{kind}")
        wide = _table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("float"))
        cli.write_tables({"customer": (wide, "c_custkey")}, f"{target}.{kind}", kind)
        return spark.read.schema(wide.schema).format(kind).load(f"{target}_customer.{kind}").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))

    return run


for _kind in ("parquet", "orc", "json"):
    QUERIES[f"sink_{_kind}"] = _through(_kind)
    ORACLE_SQL[f"sink_{_kind}"] = "SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"


@_query("SELECT CAST(CASE WHEN v < 0 THEN CAST(v AS HUGEINT) + 18446744073709551616 ELSE v END AS VARCHAR) AS v FROM (SELECT 1000 - o_custkey AS v FROM orders)")
def typed_column(spark, sf):
    """A stored column opened as a compatible type: signed numbers, some below 0, as unsigned."""
    kept = store.Store(spark, _shared(spark, "typed"))
    kept.write("orders", _table(spark, sf, "orders").select((1000 - F.col("o_custkey")).alias("v")))
    return kept.column("orders", "v", "UInt64").select(F.col("v").cast("string").alias("v"))


@_query("SELECT * FROM (VALUES ('orders', TRUE, CAST(2 AS BIGINT)), ('none', FALSE, NULL)) AS t(name, there, columns)")
def store_lookup(spark, sf):
    """Tables looked up by name, one of them not there."""
    kept = store.Store(spark, _shared(spark, "looked-up"))
    kept.write("orders", _table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    rows = [(n, kept.has(n), len(kept.table(n).columns) if kept.has(n) else None) for n in ("orders", "none")]
    return spark.createDataFrame(rows, "name string, there boolean, columns long")


@_query("SELECT 'results' AS name, CAST(count(*) * 2 AS BIGINT) AS rows FROM region UNION ALL SELECT 'results~2', count(*) FROM nation")
def store_publish(spark, sf):
    """Results published under one name: equal columns are added to, others get a number."""
    kept = store.Store(spark, _shared(spark, "published"))
    for table in ("region", "nation", "region"):
        kept.publish("results", _table(spark, sf, table))
    return store.lengths_frame({n: kept.table(n) for n in kept.names()})


@_query("SELECT * FROM (VALUES (CAST(8 AS INTEGER), CAST(7 AS INTEGER), 'lengths'), (9, 7, 'bytes')) AS t(id, parent_id, name)")
def tree_descendants(spark, sf):
    """All nodes below the date column of orders."""
    return tree.descendants(tree.tree(spark, {"orders": _table(spark, sf, "orders")}), 7).select("id", "parent_id", "name")


@_query(
    """SELECT * FROM (VALUES (CAST(0 AS INTEGER), CAST(-1 AS INTEGER), 'Table', 'region'), (1, 0, 'Binary', 'r_regionkey'),
    (5, 0, 'Split', 'other'), (6, 5, 'Binary', 'lengths'), (7, 5, 'Binary', 'bytes')) AS t(id, parent_id, encoding, name)"""
)
def tree_swap(spark, sf):
    """The subtree of region's name taken out for another."""
    nodes = tree.tree(spark, {"region": _table(spark, sf, "region")})
    other = spark.createDataFrame([(0, -1, "Split", "String", "other"), (1, 0, "Binary", "SInt32", "lengths"), (2, 0, "Binary", "UInt8", "bytes")], tree.SCHEMA)
    return tree.swap(nodes, 2, other).select("id", "parent_id", "encoding", "name")


@_query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS i, * FROM region)
    SELECT CAST(i + 2 AS INTEGER) AS line_no, '| ' || rpad(CAST(r_regionkey AS VARCHAR), 8, ' ') || ' | ' || rpad(CAST(octet_length(encode(r_name)) AS VARCHAR), 8, ' ') || ' |' AS line FROM r"""
)
def describe_leaves(spark, sf):
    """The lines of values of region's physical columns: its keys, and the lengths of its names."""
    path = _shared(spark, "described")
    container.export({"region": (_table(spark, sf, "region"), "r_regionkey")}, path, compress=False)
    lines = describe.leaves_text(container.read_file(path), "region", 5, 8, 24).split("\n")
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines) if 3 <= i < 8], "line_no int, line string")
