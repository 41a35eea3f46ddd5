"""Encode and decode operators against vectors and against plain Python."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulith.functions import types
from tabulith.operators import bitpack, choice, describe, nulls, position, runs, split


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k long, v {kind}")


def values(df, key, value="value"):
    return [r[value] for r in df.orderBy(key).collect()]


RUN_VECTORS = [
    ([1] * 7 + [5] * 5 + [1] * 5 + [3] * 6, [7, 5, 5, 6], "int"),
    ([1.1] * 7 + [5.5] * 5 + [1.2] * 2 + [1.3] * 3 + [3.4] * 6, [7, 5, 2, 3, 6], "double"),
    ([None, None, 1, None], [2, 1, 1], "int"),
    ([float("nan"), float("nan"), 1.0], [2, 1], "double"),
    ([7], [1], "int"),
    ([], [], "int"),
    (["a", "a", "", None], [2, 1, 1], "string"),
]


@pytest.mark.parametrize("rows", [3, 1000])
@pytest.mark.parametrize("vector, repeats, kind", RUN_VECTORS)
def test_runs(spark, vector, repeats, kind, rows):
    encoded = runs.encode(column(spark, vector, kind), "k", "v", rows)
    found = encoded.orderBy("run").collect()
    assert [r["repeats"] for r in found] == repeats
    assert [r["run"] for r in found] == list(range(1, len(repeats) + 1))
    assert str(values(runs.decode(encoded), "_pos")) == str(vector)


def test_runs_over_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    vector = [rng.choice([1, 1, 1, 2]) for _ in range(500)] + [9] * 300
    encoded = runs.encode(column(spark, vector, "int"), "k", "v", 40)
    expected = [(v, len(list(g))) for v, g in itertools.groupby(vector)]
    assert [(r["value"], r["repeats"]) for r in encoded.orderBy("run").collect()] == expected
    monkeypatch.setattr(position, "CHUNK_ROWS", 50)
    at = spark.createDataFrame([(i,) for i in (0, 1, 77, 499, 500, 799, 5000)], "_pos long")
    assert {(r["_pos"], r["value"]) for r in runs.lookup(encoded, at).collect()} == {(i, vector[i]) for i in (0, 1, 77, 499, 500, 799)}
    assert runs.total(encoded).first()["total"] == sum(vector)
    stats = runs.stats(encoded).first()
    assert (stats["runs"], stats["rows"], stats["longest"]) == (len(expected), 800, 300)


def test_positions_over_many_chunks(spark):
    df = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    placed = position.with_position(df, "k", 90)
    assert [(r["k"], r["_pos"]) for r in placed.orderBy("k").collect()] == [(3 * i, i) for i in range(1000)]
    sums = position.running(df, "k", F.col("n"), "s", 90)
    expected = list(itertools.accumulate((3 * i % 7 for i in range(1000)), initial=0))[:-1]
    assert [r["s"] for r in sums.orderBy("k").collect()] == expected
    assert position.skip(placed, 990, "_pos").count() == 10
    assert position.point(placed, 5).first()["k"] == 15
    assert position.slice_rows(placed, 10, 5).count() == 5
    assert position.pick_random(df, 1).count() == 1


def test_only_the_chunk_that_is_wanted_is_read(spark, tmp_path, capsys):
    """Slices and skips by chunk counts equal those by numbering, also with null keys, and filter the scan by the key."""
    path = f"file://{tmp_path}/t"
    spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    for start, count in ((0, 3), (85, 20), (500, 1), (990, 50), (2000, 5)):
        found = position.slice_of(df, "k", start, count, 90).orderBy("_pos").collect()
        assert [(r["_pos"], r["v"]) for r in found] == [(i, 3 * i) for i in range(start, min(start + count, 1000))]
        assert sorted(r["v"] for r in position.skip(df, start, "k", 90).collect()) == [3 * i for i in range(start, 1000)]
    position.slice_of(df, "k", 500, 1, 90).explain()
    plan = capsys.readouterr().out
    assert re.search(r"PushedFilters: \[[^]]*LessThan\(k,\d+\)", plan) and re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(k,\d+\)", plan)


def test_many_cuts(spark):
    values_ = [-5.0, 0.0, 0.5, 1.0, 17.0, 18.9, 399.0, 400.0]
    df = spark.createDataFrame([(v,) for v in values_], "v double")
    for cuts in ([], [0.0, 1.0], [float(i) for i in range(400)], list(range(400))):
        found = [r["n"] for r in df.select("v", position._search(F.col("v"), cuts).alias("n")).orderBy("v").collect()]
        assert found == [sum(c <= v for c in cuts) for v in values_]


def test_a_very_long_run_is_made_piece_by_piece(spark):
    long = spark.createDataFrame([(1, "a", 2**31 + 5), (2, "b", 2)], "run long, value string, repeats long")
    cut = runs.pieces(long).selectExpr("last - first + 1 AS n", "last").agg(F.sum("n"), F.max("n"), F.max("last")).first()
    assert cut[:] == (2**31 + 7, runs.PIECE_ROWS, 2**31 + 6)
    pieces = runs.decode(spark.createDataFrame([(1, "a", 200_000), (2, "b", 1)], "run long, value string, repeats long"))
    assert pieces.agg(F.count("*"), F.max("_pos"), F.count_distinct("_pos")).first()[:] == (200_001, 200_000, 200_001)


def test_split_chunks_are_bounded_in_bytes(spark):
    vector = ["x" * n for n in (0, 30, 200, 0, 5, 5, 90, 1)] * 6
    df = column(spark, vector, "string").withColumnRenamed("k", "_pos")
    chunks = split.encode(df, "v", chunk_bytes=100).collect()
    assert len(chunks) > 5 and all(sum(r["lengths"][:-1]) + 16 * (len(r["lengths"]) - 1) <= 100 for r in chunks)
    assert values(split.roundtrip(df, "v", chunk_bytes=100), "value_pos") == vector
    raw = df.select("_pos", F.unhex(F.lit("ff00")).alias("v"))
    assert {bytes(r["value"]) for r in split.decode(split.encode(raw, "v"), as_text=False).collect()} == {b"\xff\x00"}


def test_split_time_grows_with_the_values(spark):
    """One chunk of very many short values; cutting each from all of the chunk's bytes takes minutes."""
    df = spark.range(250_000).selectExpr("id as _pos", "repeat(chr(CAST(97 + id % 26 AS INT)), CAST(id % 30 AS INT)) as v")
    began = time.monotonic()
    found = split.roundtrip(df, "v").join(df.withColumnRenamed("_pos", "value_pos"), "value_pos")
    assert found.where("value = v").count() == 250_000
    assert time.monotonic() - began < 40


def test_positions_by_time(spark):
    df = spark.sql("SELECT timestampadd(SECOND, -id, timestamp'2020-01-01') AS t, id FROM range(50)")
    assert [r["id"] for r in position.with_position(df, "t", 8).orderBy("_pos").collect()] == list(range(49, -1, -1))


def test_byte_prefix(spark):
    df = column(spark, range(128, 149), "short")
    counts = [r["ones"] for r in bitpack.bit_counts(df, "v", "UInt8").orderBy("bit").collect()]
    assert counts == [21, 0, 0, 5, 8, 9, 10, 10]
    found = bitpack.prefix(df, "v", "UInt8").first()
    assert (found["prefix_length"], found["prefix"]) == (3, 0b100)


@pytest.mark.parametrize("vector, logical, kind", [
    ([5, 6, 7], "SInt64", "long"), ([-3, -1, -2], "SInt64", "long"), ([-3, -1], "SInt8", "byte"), ([2**62, 2**62 + 5], "SInt64", "long"), ([9], "SInt32", "int"),
])
def test_bit_packing_round_trip(spark, vector, logical, kind):
    df = column(spark, vector, kind)
    residuals, length, head = bitpack.encode(df, "v", logical, "k")
    assert values(bitpack.decode(residuals, length, head, logical), "_pos") == vector


def test_values_without_a_prefix_are_not_packed(spark):
    assert bitpack.encode(column(spark, [1, -2, 4], "long"), "v", "SInt64", "k") is None
    assert choice.bit_packing("SInt64", np.array([1, -2, 4])) is None
    assert bitpack.encode(column(spark, [], "long"), "v", "SInt64", "k") is None


@given(st.sampled_from(types.INTEGERS), st.data())
@settings(max_examples=60, deadline=None)
def test_words(logical, data):
    bits = 8 * types.WIDTHS[logical]
    low, high = (0, 2**bits - 1) if logical[0] == "U" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    base = data.draw(st.integers(low, high))
    vector = np.array(data.draw(st.lists(st.integers(max(low, base - 9), min(high, base + 9)), min_size=1, max_size=40)), dtype=f"<{'u' if logical[0] == 'U' else 'i'}{bits // 8}")
    length, prefix = choice.common_prefix(logical, vector)
    packed = choice.pack_words(logical, vector, length)
    assert len(packed) == len(vector) * (bits - length) // bits + 1
    assert (choice.unpack_words(logical, packed, length, prefix, len(vector)) == vector).all()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 15, 16, 17])
@pytest.mark.parametrize("null", ["none", "all", "some", "first"])
def test_nulls_round_trip(spark, n, null):
    vector = [None if null == "all" or null == "some" and i % 2 or null == "first" and not i else i * 10 for i in range(n)]
    df = column(spark, vector, "int").withColumnRenamed("k", "_pos")
    bits, dense = nulls.bitmap(df, "v"), nulls.dense(df, "v")
    assert values(dense, "dense_pos") == [v for v in vector if v is not None]
    assert all(0 <= r["bits"] <= 255 for r in bits.collect())
    assert values(nulls.merge(bits, dense, n), "_pos") == vector


@pytest.mark.parametrize("vector", [["Hello world", "testing1234"], ["æ", "", "😀x", "long" * 500], ["", ""], []])
def test_split_round_trip(spark, vector):
    df = column(spark, vector, "string").withColumnRenamed("k", "_pos")
    assert values(split.roundtrip(df, "v", chunk_bytes=40), "value_pos") == vector
    sizes = [len(v.encode()) for v in vector]
    found = split.offsets(df, "v").orderBy("_pos").collect()
    assert [(r["length"], r["offset"]) for r in found] == list(zip(sizes, itertools.accumulate(sizes, initial=0), strict=False))


@pytest.mark.parametrize("rows, blocks, share, taken", [(1, 10, 0.2, 1), (20, 10, 0.1, 20), (100, 10, 0.2, 20), (100, 10, 0.1, 10), (128, 5, 0.1, 10), (1024, 10, 0.1, 100)])
def test_block_sample(spark, rows, blocks, share, taken):
    df = spark.range(rows).withColumnRenamed("id", "_pos")
    options = choice.Options(blocks=blocks, share=share)
    for seed in (None, 4):
        found = sorted(r["_pos"] for r in choice.block_sample(df, rows, options, seed).collect())
        assert len(found) == taken
        if taken < rows:
            each = taken // blocks
            for i in range(blocks):
                block = found[i * each : (i + 1) * each]
                assert block == list(range(block[0], block[0] + each)) and block[0] // (rows // blocks) == i


def test_choice():
    assert choice.pick("SInt32", np.full(1000, 7, np.int32), 2).describe() == "BitPacking(Binary)" or choice.pick("SInt32", np.full(1000, 7, np.int32), 2).total() < 100
    assert choice.pick("SInt32", np.random.default_rng(1).integers(-(2**31), 2**31, 500).astype(np.int32), 2).encoding == "Binary"
    assert choice.pick("Float64", np.repeat([1.5, 2.5], 500), 2).encoding == "RunLength"
    nested = choice.pick("SInt64", np.repeat(np.arange(10) + 2**40, 100), 2)
    assert nested.encoding == "RunLength" and nested.parts[0].encoding == "BitPacking"
    assert choice.pick("SInt32", np.full(1000, 7, np.int32), 0).encoding == "Binary"


def test_own_encoding():
    halves = {"Halves": lambda kind, v: ([(kind, v[: len(v) // 8])], {})}
    assert choice.pick("SInt32", np.arange(64, dtype=np.int32), 1, halves).encoding == "Halves"


def test_choose_from_a_sample(spark):
    df = spark.range(5000).select("id", F.lit("same").alias("s"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    assert [n.encoding for n in choice.choose(df, "s", "id")][0] in ("BitPacking", "RunLength")
    assert len(choice.choose(df, "n", "id")) == 2
    assert sorted(map(str, choice.costs(df, "id", rows=300).collect())) == sorted(map(str, choice.costs(df, "id").collect()))
    assert choice.costs(df.limit(0), "id").select("rows", "run_length").distinct().collect() == [(0, 0)]
    costs = {r["column"]: r for r in choice.costs(df, "id").collect()}
    assert costs["s"]["plain"] == 20000 and costs["s"]["run_length"] == 8
    assert {r["column"]: r["encoding"] for r in choice.choices(choice.costs(df, "id")).collect()}["s"] == "RunLength"


GUESSES = [
    (["1", "-1"], "String"), (["1.5", "2"], "String"), (["1", "", "300"], "UInt16"), (["1e5", "1e300"], "Float16"), (["", None], "Blob"),
    (["18446744073709551616"], "String"), (["18446744073709551615"], "UInt64"), (["-1", "-129"], "SInt16"), (["-1", "0"], "String"), (["abc"], "String"),
    (["-5", "x"], "String"), (["-", "1"], "String"), (["+5"], "UInt8"), (["-9223372036854775808"], "SInt64"), (["1.2.3"], "String"), (["-0"], "SInt8"), (["e"], "String"),
]


@pytest.mark.parametrize("texts, expected", GUESSES)
def test_guess(spark, texts, expected):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.agg(types.guess(F.col("t")).alias("g")).first()["g"] == expected


def test_guess_with_widening(spark):
    guess = lambda *t: spark.createDataFrame([(x,) for x in t], "t string").agg(types.guess(F.col("t"), widening=True).alias("g")).first()["g"]
    assert guess("1", "-1") == "SInt8" and guess("1.5", "2") == "Float64" and guess("1", "x") == "String"


def test_types():
    assert [types.compatible("String", "Blob"), types.compatible("SInt8", "UInt8"), types.compatible("SInt8", "SInt16"), types.compatible("Float32", "SInt32")] == [True, True, False, False]


@pytest.mark.parametrize("logical, value, expected", [("UInt8", -1, 255), ("UInt16", -2, 65534), ("UInt32", -1, 2**32 - 1), ("UInt64", -1, 2**64 - 1), ("SInt8", 255, -1), ("SInt64", 2**64 - 1, -1), ("SInt16", 5, 5)])
def test_reinterpret(spark, logical, value, expected):
    df = spark.createDataFrame([(str(value),)], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
    df = df if abs(value) > 2**62 else df.select(F.col("v").cast("long").alias("v"))
    row = df.select(types.reinterpret(F.col("v"), logical).alias("r"), types.in_range(F.col("v"), logical).alias("ok")).first()
    assert row["r"] == expected and row["ok"] == (expected == value)


def test_describe(spark):
    df = column(spark, ["x" * 20, None, "æ"], "string")
    assert [r["v"] for r in describe.preview(df, "k", 15, 12).collect()] == ["x" * 12, " " * 12, "æ" + " " * 11]
    assert describe.centre("abc", 6) == " abc  " and describe.centre("abcdef", 3) == "abcdef"
    assert "[ln: 3]" in describe.preview_text(df, "t", "k")
