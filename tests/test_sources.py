"""Container, store, text formats, conversion and capture."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith import cli
from tabulith.functions import types
from tabulith.plans import tree
from tabulith.sources import container, ingest, store, synthetic, text
from tabulith.streaming import capture

VALUES = {name: list(range(10)) for name in types.NUMERIC} | {"String": ["", "æ", "x" * 300, "a"], "Blob": [b"", b"\x00\xff", b"abc", b"d"]}


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("density", ["all", "half", "none"])
def test_container_round_trip(tmp_path, compress, density):
    path = str(tmp_path / "a.container")
    hide = lambda v: [x if density == "all" or density == "half" and i % 2 else None for i, x in enumerate(v)]
    tables = {f"t/{n}": [("c", n, hide(v)), ("empty", n, [])] for n, v in VALUES.items()}
    container.write_file(path, tables, compress)
    file = container.read_file(path)
    assert list(file.tables) == list(tables)
    for table, columns in tables.items():
        for name, kind, vector in columns:
            found = file.column(file.tables[table][1][name])
            found = [v.decode() if kind == "String" and v is not None else v for v in (found if isinstance(found, list) else found.tolist())]
            assert found == vector


@pytest.mark.parametrize("vector", [[1] * 7 + [5] * 5 + [1] * 5 + [3] * 6, list(range(1000, 2000)), [-1, 2, -3] * 50, [2**40 + i // 50 for i in range(1000)], [7]])
def test_compressed_numbers(tmp_path, vector):
    path = str(tmp_path / "a.container")
    container.write_file(path, {"t": [("c", "SInt64", vector)]})
    file = container.read_file(path)
    assert list(file.column(file.tables["t"][1]["c"])) == vector


def test_nullable_strings_and_a_null(tmp_path):
    path, vector = str(tmp_path / "a.container"), [f"v{i}" for i in range(16)] + [None, ""]
    container.write_file(path, {"t": [("c", "String", vector)]})
    file = container.read_file(path)
    assert [v if v is None else v.decode() for v in file.column(file.tables["t"][1]["c"])] == vector


def test_container_bytes(tmp_path):
    """A table of three plain columns, byte for byte."""
    path = tmp_path / "a.container"
    container.write_file(str(path), {"table": [(f"column{c}", "SInt32", [1, 2]) for c in "ABC"]}, compress=False)
    name = lambda s: struct.pack("<i", len(s)) + s
    blobs = [struct.pack("<iq", 8, 8 + 8 * i) for i in range(3)] + [name(b"table") + name(b"columnA") + name(b"columnB") + name(b"columnC")]
    meta = b"".join([
        struct.pack("<4i", 1, 2, 3, 0), struct.pack("<4i", 0, 0, 0, -1), bytes([1, 1, 1, 0]), bytes([2, 2, 2, 4]), struct.pack("<4i", 2, 2, 2, 2),
        struct.pack("<4i", *map(len, blobs)), *blobs,
    ])
    body = container.MAGIC + struct.pack("<2i", 1, 2) * 3
    assert path.read_bytes() == body + meta + struct.pack("<3q", len(body), len(meta), 4) + container.MAGIC


@pytest.mark.parametrize("damage", [lambda b: b"X" + b[1:], lambda b: b[:-1] + b"X", lambda b: b[:40], lambda b: b"", lambda b: b[:-32] + struct.pack("<q", 10**9) + b[-24:]])
def test_damaged_containers(tmp_path, damage):
    path = tmp_path / "a.container"
    container.write_file(str(path), {"t": [("c", "SInt32", [1, 2, 3])]})
    path.write_bytes(damage(path.read_bytes()))
    with pytest.raises(container.ContainerError):
        container.read_file(str(path))


def test_names_that_are_there_twice(tmp_path, spark):
    with pytest.raises(container.ContainerError):
        container.write_file(str(tmp_path / "a"), {"t": [("c", "SInt32", [1]), ("c", "SInt32", [1])]})
    with pytest.raises(ValueError):
        store.check_names(spark.range(1).selectExpr("id AS a", "id AS A"))


def test_cursor():
    raw = struct.pack("<ih", 5, 7) + struct.pack("<i", 4) + b"test" + struct.pack("<i", 2) + "æ".encode()
    cursor = container.Cursor(raw)
    assert cursor.number("i", ahead=True) == 5 and cursor.number("i") == 5 and cursor.number("h") == 7
    assert cursor.string() == "test" and cursor.string() == "æ" and cursor.done()
    with pytest.raises(container.ContainerError):
        cursor.number("i")


def test_container_source(tmp_path, spark):
    container.register(spark)
    path = str(tmp_path / "a.container")
    df = spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("n"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), "id")).alias("s"), (F.col("id") / 2).alias("d"))
    container.export({"a/b": (df, "id"), "c": (spark.range(3), "id")}, path)
    back = spark.read.format("container").option("table", "a/b").load(path)
    assert [tuple(r)[1:] for r in back.orderBy("_pos").collect()] == [tuple(r) for r in df.orderBy("id").collect()]
    some = spark.read.format("container").option("table", "a/b").schema("n int").load(path)
    assert some.agg(F.sum("n")).first()[0] == sum(i % 3 for i in range(200))
    assert container.nodes_frame(spark, container.read_file(path)).where("parent_id = -1").count() == 2


def test_unsigned_and_half(tmp_path, spark):
    container.register(spark)
    path = str(tmp_path / "a.container")
    container.write_file(path, {"t": [("u", "UInt64", [2**64 - 1, 0]), ("h", "Float16", [0.5, -2.0]), ("b", "UInt8", [255, 0])]})
    row = spark.read.format("container").option("table", "t").load(path).orderBy("_pos").first()
    assert (int(row["u"]), row["h"], row["b"]) == (2**64 - 1, 0.5, 255)


def test_store(tmp_path, spark):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    assert kept.names() == [] and kept.size() == 0
    kept.write("step/result one", spark.range(10), sort_by="id")
    kept.write("step/result one", spark.range(5), mode="append")
    assert kept.names() == ["step/result one"] and kept.table("step/result one").count() == 15
    with pytest.raises(ValueError):
        kept.write("step/result one", spark.range(5).selectExpr("id AS other"), mode="append")
    assert kept.publish("step/result one", spark.range(2)) == "step/result one"
    assert kept.publish("step/result one", spark.range(2).selectExpr("id AS other")) == "step/result one~2"
    assert kept.has("step/result one~2") and not kept.has("none")
    assert kept.catalogue().count() == 2 and kept.size() > 0
    assert kept.column("step/result one", "id", "UInt64").dtypes == [("id", "decimal(20,0)")]
    with pytest.raises(TypeError):
        kept.column("step/result one", "id", "Float64")


def test_text(tmp_path, spark):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x, y",3\n4,5\n,"he said ""no""",z\n')
    df = text.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert [tuple(r) for r in df.collect()] == [("1", "x, y", "3"), ("4", "5", ""), ("", 'he said "no"', "z")]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert text.read_csv(spark, f"file://{tmp_path}/h.csv").count() == 0
    rows = spark.createDataFrame([(1, "x, y", None, bytearray(b"\x01")), (0, 'q"', "", None)], "k int, s string, t string, b binary")
    assert [r["line"] for r in text.csv_lines(rows, "k").orderBy("line_no").collect()] == ["k,s,t,b", '0,q",,', '1,"x, y",,01']
    schema = text.parse_ddl("CREATE TABLE A ( x INTEGER NOT NULL,\n y DECIMAL(15,2),\n z VARCHAR(9) );\nCREATE TABLE LINEITEM ( x INTEGER );", ("LINEITEM",))
    assert list(schema) == ["A"] and schema["A"].simpleString() == "struct<x:int,y:float,z:string>"
    parsed = text.parse_tbl(spark.createDataFrame([("1| 2.5 |abc|",), ("x|1|",)], "value string"), schema["A"])
    assert [tuple(r) for r in parsed.collect()] == [(1, 2.5, "abc"), (None, 1.0, None)]


def test_union_of_schemas(spark):
    out = store.union_of([spark.range(1), spark.range(1).selectExpr("id", "'x' AS s")])
    assert out.columns == ["id", "s"] and out.count() == 2


def test_tree(spark):
    df = spark.createDataFrame([(1, "x")], "columnA int, columnB string")
    nodes = tree.tree(spark, {"t": df, "u": spark.range(1)})
    assert [(r["id"], r["parent_id"]) for r in nodes.collect()] == [(1, 0), (3, 2), (4, 2), (2, 0), (0, -1), (6, 5), (5, -1)]
    assert {r["id"]: r["depth"] for r in tree.depths(nodes).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 1}
    assert {r["id"] for r in tree.descendants(nodes, 0).collect()} == {1, 2, 3, 4}
    assert [r["id"] for r in tree.children(nodes, 2).collect()] == [3, 4]
    assert tree.replace(nodes, 1, "RunLength").where("id = 1").first()["encoding"] == "RunLength"


def test_convert_and_describe(tmp_path, spark, capsys):
    (tmp_path / "in.csv").write_text("a,b\n" + "".join(f"{i},w{i % 3}\n" for i in range(50)))
    at = lambda name: f"{tmp_path}/{name}"
    assert cli.main(["convert", at("in.csv"), at("x.Container")]) == 0
    assert cli.main(["convert", at("x.Container"), at("out.csv")]) == 0
    lines = [x for p in (tmp_path / "out.csv").glob("part-*") for x in p.read_text().splitlines()]
    assert lines[0] == "a,b" and lines[1:] == [f"{i},w{i % 3}" for i in range(50)]
    assert cli.main(["convert", at("x.Container"), at("y.parquet")]) == 0
    assert spark.read.parquet(at("y_CSVTable.parquet")).count() == 50
    assert cli.main(["convert", at("y_CSVTable.parquet"), at("keep"), "--to", "store"]) == 0
    assert store.Store(spark, at("keep")).table("y_CSVTable").count() == 50
    assert cli.main(["describe", at("x.Container"), "-f"]) == 0
    shown = capsys.readouterr().out
    assert "CSVTable" in shown and "[ln: " in shown and "Split" in shown
    assert cli.main(["convert", at("in.csv"), at("plain.container"), "-s", "-v"]) == 0
    assert cli.main(["describe", at("plain.container"), "-f", "-c", "2", "-n", "6"]) == 0
    shown = capsys.readouterr().out
    # each column is lengths and bytes: 10 + 2 * 40 digits, and 2 * 50 letters
    assert shown.count("[ln: 50]") == 2 and "[ln: 90]" in shown and "[ln: 100]" in shown and "encodings: Split" in shown and "BitPacking" not in shown
    assert cli.main(["describe", at("plain.container"), "--no-header", "-f", "-l"]) == 0
    assert cli.main(["convert", at("in.csv"), at("x.what")]) == 1
    (tmp_path / "bad.container").write_bytes(b"no")
    assert cli.main(["describe", at("bad.container")]) == 1


def test_formats_by_ending():
    assert [cli.format_of(p) for p in ("a.CSV", "a.parquet", "b/c.Container", "x.y", "folder/")] == ["csv", "parquet", "container", "unknown", "store"]


def test_capture(tmp_path, spark, sf):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    for _ in range(2):  # the second run finds nothing new
        capture.capture(stream(), kept, "s/events", f"file://{tmp_path}/state").awaitTermination()
    assert kept.table("s/events").drop("_batch").exceptAll(events).count() == 0 and kept.table("s/events").count() == events.count()
    capture.route(stream(), kept, "user_id", "event_type", f"file://{tmp_path}/state2").awaitTermination()
    assert kept.table("results").select("_table").distinct().count() == events.select("user_id", "event_type").distinct().count()


def test_listener(tmp_path, spark):
    life = capture.Listener(store.Store(spark, f"file://{tmp_path}/s"), ("p", "plan"))
    life.result("s1", "r", spark.range(3))
    life.result("s1", "r", spark.range(2))
    life.step("s1", "p", "first")
    life.complete(spark.createDataFrame([("p", 1.5, "Pass")], "id string, limit double, Verdict string"), "id", {"limit": "group"})
    assert life.store.table("s1/r").count() == 5
    assert {tuple(r) for r in life.store.table("__ancestry__").collect()} == {("s1", "p", "first"), ("p", None, "plan")}
    assert {tuple(r) for r in life.store.table("__params__").collect()} == {("p", "group/limit", 14, "1.5"), ("p", "Verdict", 18, "Pass")}


def test_synthetic(spark):
    df = synthetic.wide(spark, 200, 0.5)
    assert len(df.columns) == 101 and df.count() == 400
    assert synthetic.table(spark, 10, {"o": "ordered"}).orderBy("_pos").select("o").toPandas()["o"].tolist() == list(range(10))
    assert np.isfinite(df.select("double0").dropna().toPandas()["double0"]).all()


@pytest.mark.parametrize("kind", list(ingest._OF_DTYPE.values()))
@pytest.mark.parametrize("nullable", [False, True])
def test_ingest_every_type(spark, kind, nullable):
    dtype = next(d for d, k in ingest._OF_DTYPE.items() if k == kind)
    values = np.arange(10).astype(dtype)
    given = [None if i % 3 == 0 else v for i, v in enumerate(values)] if nullable else values
    df = ingest.from_arrays(spark, {"c": given})
    assert types.logical_type(df.schema["c"]) == kind
    assert [None if r["c"] is None else float(r["c"]) for r in df.orderBy("_pos").collect()] == [None if nullable and i % 3 == 0 else float(i) for i in range(10)]


def test_ingest_texts(spark):
    df = ingest.from_arrays(spark, {"s": ["a", None], "b": [b"x"], "n": [2**64 - 1, 0]}, {"n": "UInt64"})
    assert [(r["s"], r["b"] and bytes(r["b"]), int(r["n"])) for r in df.orderBy("_pos").collect()] == [("a", b"x", 2**64 - 1), (None, None, 0)]
    with pytest.raises(TypeError):
        ingest.from_arrays(spark, {"x": [object()]})
    with pytest.raises(TypeError):
        ingest.from_arrays(spark, {"x": [True]})


def test_builder_keeps_to_a_type(spark):
    built = ingest.Builder({"a": "SInt16"}).extend("a", [1, None, 3]).append("b", "x")
    df = built.build(spark)
    assert dict(df.dtypes) == {"_pos": "bigint", "a": "smallint", "b": "string"} and df.count() == 3
    with pytest.raises(TypeError):
        built.append("b", 5)
    with built.cell("c") as stream:
        stream.write(b"ab")
        stream.write(b"c")
    assert [r["c"] for r in built.build(spark).orderBy("_pos").collect()] == [bytearray(b"abc"), None, None]


def test_inline_values():
    cursor = container.Cursor(b"".join(len(x).to_bytes(4, "little") + x for x in (b"a", b"", b"ccc")))
    assert (cursor.peek_blob(), cursor.peek_blob(2), cursor.at) == (b"a", b"ccc", 0)
    assert [cursor.seek(p).blob() for p in reversed(cursor.places())] == [b"ccc", b"", b"a"]
    with pytest.raises(container.ContainerError):
        cursor.seek(0).skip_blobs(4)


def test_containers_by_task(spark, tmp_path):
    container.register(spark)
    path = f"file://{tmp_path}/c"
    df = spark.range(0, 100, 1, 3).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('w', id) END AS word", "id / 4 AS part", "id > 50 AS flag")
    write = lambda x, mode: x.write.format("container").option("table", "t").option("rows", 20).mode(mode).save(path)
    write(df, "overwrite")
    found = spark.read.format("container").option("table", "t").load(path).orderBy("_pos").collect()
    assert [r["_pos"] for r in found] == list(range(100)) and [(r["id"], r["word"], r["part"]) for r in found] == [(i, None if i % 3 == 0 else f"w{i}", i / 4) for i in range(100)]
    write(df.limit(5), "append")
    assert spark.read.format("container").option("table", "t").load(path).count() == 105
    write(df.limit(0), "overwrite")
    left = spark.read.format("container").option("table", "t").load(path)
    assert left.count() == 0 and left.columns == ["_pos", "id", "word", "part", "flag"]


def test_swapped_subtrees(spark):
    nodes = tree.tree(spark, {"t": spark.createDataFrame([], "a int, b string")})
    with pytest.raises(ValueError):
        tree.swap(nodes, 99, nodes)
    assert tree.swap(nodes, 0, nodes).where("parent_id = -1").count() == 1
