"""The binary container: read and written for interchange.

A file is a magic number, the bytes of all leaf columns, six metadata columns of one row a
node, and a postscript of three integers and the magic number. All numbers are little-
endian. read_file() gives a file's nodes and columns; write_file() writes tables; the
`container` data source reads one table of one or many files as a DataFrame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tabulith.functions import types as logical
from tabulith.operators import choice, nulls
from tabulith.operators.position import POS
from tabulith.plans.tree import ENCODING_TAGS

# The magic number, and the numbers before the closing one.
MAGIC = b"OTAPR\x01\x00\x00"
POSTSCRIPT = struct.Struct("<qqq")
#: Rows of a file that a task writes and of a batch that it reads, at most; the list of a folder's files.
FILE_ROWS, BATCH_ROWS, LIST = 1_000_000, 65_536, "_files"
ENCODING_NAMES = {tag: name for name, tag in ENCODING_TAGS.items()}


class ContainerError(ValueError):
    """A file that is no container, or a damaged one."""


@dataclass
class Part:
    """A node of a file: what the metadata say of it, and its parts."""

    id: int
    parent: int
    encoding: str
    logical: str
    rows: int
    blob: bytes
    parts: list[Part] = field(default_factory=list)


class Cursor:
    """A bounds-checked walk over bytes: numbers, length-prefixed blobs and strings."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _next(self, size: int, ahead: bool = False) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise ContainerError(f"{size} bytes from {self.at} on go beyond {len(self.data)}")
        found = self.data[self.at : self.at + size]
        self.at += 0 if ahead else size
        return found

    def number(self, form: str, ahead: bool = False):
        return struct.unpack(f"<{form}", self._next(struct.calcsize(f"<{form}"), ahead))[0]

    def numbers(self, form: str, count: int) -> np.ndarray:
        return np.frombuffer(self._next(np.dtype(f"<{form}").itemsize * count), f"<{form}")

    def blob(self) -> bytes:
        return self._next(self.number("i"))

    def string(self) -> str:
        return self.blob().decode()

    def skip(self, units: int, size: int) -> None:
        self._next(units * size)

    def skip_blobs(self, count: int) -> None:
        """Pass over so many length-prefixed values."""
        for _ in range(count):
            self._next(self.number("i"))

    def peek_blob(self, ahead: int = 0) -> bytes:
        """The length-prefixed value that stands so many values on; the cursor stays."""
        at = self.at
        try:
            self.skip_blobs(ahead)
            return self.blob()
        finally:
            self.at = at

    def places(self) -> list[int]:
        """Where each of the length-prefixed values from here to the end starts: what seek() takes for random access."""
        at, found = self.at, []
        while not self.done():
            found.append(self.at)
            self.skip_blobs(1)
        self.at = at
        return found

    def seek(self, place: int) -> Cursor:
        self.at = place
        return self

    def done(self) -> bool:
        return self.at >= len(self.data)


def _dtype(kind: str) -> np.dtype:
    return np.dtype("<" + {"S": "i", "U": "u", "F": "f"}[kind[0]] + str(logical.WIDTHS[kind]))


def _metadata(data: bytes, rows: int) -> dict[int, Part]:
    cursor = Cursor(data)
    ids, parents, tags, kinds, lengths, sizes = (cursor.numbers(f, rows).tolist() for f in ("i4", "i4", "u1", "u1", "i4", "i4"))
    nodes = {}
    for i, parent, tag, kind, length, size in zip(ids, parents, tags, kinds, lengths, sizes, strict=True):
        if tag not in ENCODING_NAMES or kind >= len(logical.NAMES):
            raise ContainerError(f"node {i} has an unknown encoding or type ({tag}, {kind})")
        nodes[i] = Part(i, parent, ENCODING_NAMES[tag], logical.NAMES[kind], length, cursor._next(size))
    for i in sorted(nodes):
        if nodes[i].parent >= 0:
            nodes[nodes[i].parent].parts.append(nodes[i])
    return nodes


class File:
    """A container that is open for reading; a column's bytes are read when it is asked for."""

    def __init__(self, source, size: int):
        self.source = source
        tail = POSTSCRIPT.size + len(MAGIC)
        if size < tail + len(MAGIC) or self._read(0, len(MAGIC)) != MAGIC:
            raise ContainerError("the file doesn't start with the magic number")
        end = self._read(size - tail, tail)
        if end[POSTSCRIPT.size :] != MAGIC:
            raise ContainerError("the file doesn't end with the magic number")
        at, length, rows = POSTSCRIPT.unpack(end[: POSTSCRIPT.size])
        if min(at, length, rows) < 0 or at + length > size - tail:
            raise ContainerError("the postscript points outside the file")
        self.nodes = _metadata(self._read(at, length), rows)
        self.tables: dict[str, tuple[Part, dict[str, Part]]] = {}
        for node in self.nodes.values():
            if node.parent == -1:
                names = Cursor(node.blob)
                table, columns = names.string(), []
                while not names.done():
                    columns.append(names.string())
                if table in self.tables or len(set(columns)) < len(columns):
                    raise ContainerError(f"{table}: a table's or column's name is there twice")
                self.tables[table] = (node, dict(zip(columns, node.parts, strict=True)))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def column(self, node: Part) -> list | np.ndarray:
        """All values of a node: an array of numbers, or a list of bytes and nulls."""
        if node.encoding == "Binary":
            about = Cursor(node.blob)
            size, at = about.number("i"), about.number("q")
            return np.frombuffer(self._read(at, size), _dtype(node.logical))
        parts = [self.column(p) for p in node.parts]
        if node.encoding == "RunLength":
            return np.repeat(parts[0], parts[1])
        if node.encoding == "BitPacking":
            about = Cursor(node.blob)
            length, prefix = about.number("B"), about.number("Q")
            return choice.unpack_words(node.logical, parts[0], length, prefix, node.rows)
        if node.encoding == "Split":
            # what stands behind the last value (lengths of 0) is passed over
            raw, ends = np.asarray(parts[1], np.uint8).tobytes(), np.cumsum(parts[0][: node.rows])
            return [raw[e - n : e] for e, n in zip(ends.tolist(), np.asarray(parts[0])[: node.rows].tolist(), strict=True)]
        if node.encoding == "Null":
            null = np.unpackbits(np.asarray(parts[0], np.uint8), bitorder="little")[: node.rows].astype(bool)
            values = iter(parts[1] if isinstance(parts[1], list) else parts[1].tolist())
            return [None if n else next(values) for n in null]
        raise ContainerError(f"a {node.encoding} node is no column")


    def leaves(self, node: Part) -> list[Part]:
        """The nodes below a node, or the node itself, that hold bytes of the file, in order of their ids."""
        return [node] if node.encoding == "Binary" else [x for p in node.parts for x in self.leaves(p)]


def read_file(path: str, filesystem: pyarrow.fs.FileSystem | None = None) -> File:
    if filesystem is None:
        filesystem, path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    source = filesystem.open_input_file(path)
    return File(source, source.size())


class _Out:
    """A file that is being written: where it stands, and the metadata so far."""

    def __init__(self, sink):
        self.sink, self.at, self.rows, self.last = sink, 0, [], 0
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)


def _plain(kind: str, values: list, name: str) -> tuple:
    """A column as nested (encoding, type, rows, parts or values, facts)."""
    if any(v is None for v in values):
        bits = np.zeros(8 * nulls.bitmap_bytes(len(values)), np.uint8)
        bits[: len(values)] = [v is None for v in values]
        inner = _plain(kind, [v for v in values if v is not None], name)
        return ("Null", kind, len(values), [("Binary", "UInt8", len(bits) // 8, np.packbits(bits, bitorder="little"), {}), inner], {"length": len(values)})
    if logical.WIDTHS[kind] is None:
        lengths, data = (v for _, v in choice.leaves(kind, values))
        return ("Split", kind, len(values), [("Binary", "SInt32", len(lengths), lengths, {}), ("Binary", "UInt8", len(data), data, {})], {})
    if kind in logical.INTEGERS:
        return ("Binary", kind, len(values), np.array([int(v) for v in values], _dtype(kind)), {})
    return ("Binary", kind, len(values), np.array(values, _dtype(kind)), {})


def _compress(node: tuple, encodings: dict[str, choice.Encode] | None, options: choice.Options) -> tuple:
    """A plain column as the tree that a sample of each of its leaves asks for."""
    encoding, kind, rows, inner, about = node
    if encoding != "Binary":
        return encoding, kind, rows, [_compress(p, encodings, options) for p in inner], about
    return replay(kind, inner, choice.pick(kind, choice.sample(inner, options), options.levels, encodings), encodings)


def replay(kind: str, values: np.ndarray, tree: choice.Node, encodings: dict[str, choice.Encode] | None = None) -> tuple:
    """All values of a column encoded as a tree that was chosen for some of them.

    Where an encoding doesn't fit the whole column, as when a prefix that the sample shares
    is not shared by all, the column stays plain there.
    """
    made = None if tree.encoding == "Binary" else (choice.ENCODINGS | (encodings or {}))[tree.encoding](kind, values)
    if made is None:
        return ("Binary", kind, len(values), values, {})
    parts, facts = made
    return (tree.encoding, kind, len(values), [replay(t, v, c, encodings) for (t, v), c in zip(parts, tree.parts, strict=True)], facts)


def _write_node(out: _Out, node: tuple, parent: int, names: bytes | None = None) -> None:
    encoding, kind, rows, inner, about = node
    mine, out.last = out.last, out.last + 1
    if encoding == "Binary":
        data = np.ascontiguousarray(inner).tobytes()
        blob = struct.pack("<iq", len(data), out.at)
        out.put(data)
    else:
        blob = {"BitPacking": lambda: struct.pack("<BQ", about["prefix_length"], about["prefix"]), "Null": lambda: struct.pack("<i", about["length"]), "Table": lambda: names}.get(encoding, lambda: b"")()
        for part in inner:
            _write_node(out, part, mine)
    out.rows.append((mine, parent, ENCODING_TAGS[encoding], logical.TAGS[kind], rows, blob))


def write_file(path: str, tables: dict[str, list[tuple[str, str, list]]], compress: bool = True, encodings: dict[str, choice.Encode] | None = None, options: choice.Options = choice.Options()) -> None:
    """Write tables of (name, logical type, values) columns; the file appears under its name when it is whole.

    With compress each leaf column has the tree that options' sample of it asks for.
    """
    files, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    text = lambda s: struct.pack("<i", len(s.encode())) + s.encode()
    with files.open_output_stream(place + ".part") as sink:
        out = _Out(sink)
        for table, columns in tables.items():
            if len({c for c, _, _ in columns}) < len(columns):
                raise ContainerError(f"{table}: a column's name is there twice")
            plain = [_plain(kind, values, name) for name, kind, values in columns]
            parts = [_compress(p, encodings, options) for p in plain] if compress else plain
            _write_node(out, ("Table", "UInt8", parts[0][2] if parts else 0, parts, {}), -1, text(table) + b"".join(text(c) for c, _, _ in columns))
        start = out.at
        for i, form in enumerate(("<i4", "<i4", "u1", "u1", "<i4")):
            out.put(np.array([r[i] for r in out.rows], form).tobytes())
        out.put(np.array([len(r[5]) for r in out.rows], "<i4").tobytes() + b"".join(r[5] for r in out.rows))
        out.put(POSTSCRIPT.pack(start, out.at - start, len(out.rows)) + MAGIC)
    files.move(place + ".part", place)


def export(tables: dict[str, tuple[DataFrame, str]], path: str, **options) -> None:
    """Write DataFrames, each with the column that orders it, to one container; `_pos` itself is not written.

    The format is one file whose columns are each one run of bytes, so all rows come to the
    driver: it is for results of a size that one machine holds; larger ones are written by
    the data source, a file a task, or stay in a store. Types that the format lacks are written as text.
    """
    out = {}
    for name, (df, order) in tables.items():
        fields = [f for f in df.schema if f.name != POS]
        frame = df.orderBy(order).select(*[df[f.name] if logical.logical_type(f) != "String" else df[f.name].cast("string") for f in fields]).toArrow()
        out[name] = [(f.name, logical.logical_type(f), frame[f.name].to_pylist()) for f in fields]
    write_file(path, out, **options)


def nodes_frame(spark: SparkSession, file: File) -> DataFrame:
    """id, parent_id, encoding, logical, length, blob of every node of a file."""
    rows = [(n.id, n.parent, n.encoding, n.logical, n.rows, bytearray(n.blob)) for n in file.nodes.values()]
    return spark.createDataFrame(rows, "id int, parent_id int, encoding string, logical string, length int, blob binary")


def _spark_schema(file: File, table: str) -> T.StructType:
    return T.StructType([T.StructField("_pos", T.LongType())] + [logical.field(name, node.logical) for name, node in file.tables[table][1].items()])


@dataclass
class OneFile(InputPartition):
    path: str
    first: int = 0


class ContainerReader(DataSourceReader):
    def __init__(self, files: list[OneFile], table: str, schema: T.StructType):
        self.files, self.table, self.wanted = files, table, schema

    def partitions(self) -> list[InputPartition]:
        return list(self.files)

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        """Only the columns of the wanted schema are read; a shorter one is filled up with nulls."""
        from pyspark.sql.pandas.types import to_arrow_type

        file = read_file(partition.path)
        node, columns = file.tables[self.table]
        found = {f.name: file.column(columns[f.name]) for f in self.wanted if f.name != "_pos"}
        rows = max([len(v) for v in found.values()] or [node.rows])
        arrays = []
        for f in self.wanted:
            kind = to_arrow_type(f.dataType)
            values = range(partition.first, partition.first + rows) if f.name == "_pos" else found[f.name]
            if isinstance(values, np.ndarray) and len(values) == rows and values.dtype == np.dtype(kind.to_pandas_dtype()):
                arrays.append(pa.array(values))  # numbers go to Arrow as they are
                continue
            values = list(values if isinstance(values, (list, range)) else values.tolist())
            values += [None] * (rows - len(values))
            if isinstance(f.dataType, T.StringType):
                values = [v if v is None else v.decode() for v in values]
            if isinstance(f.dataType, T.DecimalType):
                arrays.append(pa.array([None if v is None else Decimal(v) for v in values], kind))
            else:
                arrays.append(pa.array(values, kind))
        whole = pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.wanted])
        for at in range(0, max(rows, 1), BATCH_ROWS):
            yield whole.slice(at, BATCH_ROWS)


@dataclass
class Files(WriterCommitMessage):
    """Files that a task wrote, with their rows, and the task's number."""

    task: int
    files: list[tuple[str, int]]


class ContainerWriter(DataSourceWriter):
    """Each task writes its rows as containers of at most `rows` rows; the folder's list names those that count.

    So no row goes through the driver, and files of tasks that ran twice are not read.
    """

    def __init__(self, path: str, table: str, schema: T.StructType, rows: int, overwrite: bool):
        self.path, self.table, self.fields, self.rows, self.overwrite = path.rstrip("/"), table, [f for f in schema if f.name != POS], rows, overwrite
        self.at = [i for i, f in enumerate(schema) if f.name != POS]

    def write(self, iterator: Iterator) -> Files:
        task, made, held = TaskContext.get(), [], []
        files, folder = _open(self.path)
        files.create_dir(folder, recursive=True)

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.container"
            columns = [(f.name, logical.logical_type(f), [v if v is None or isinstance(v, (int, float, str, bytes, bytearray)) and not isinstance(v, bool) else str(v) for v in values]) for f, values in zip(self.fields, zip(*held, strict=True), strict=True)]
            write_file(f"{self.path}/{name}", {self.table: columns})
            made.append((name, len(held)))
            held.clear()

        for row in iterator:
            held.append([row[i] for i in self.at])
            if len(held) == self.rows:
                close()
        if held:
            close()
        elif task.partitionId() == 0 and not made:  # a table without rows still has its columns
            made.append((f"part-00000-{task.taskAttemptId()}-none.container", 0))
            write_file(f"{self.path}/{made[0][0]}", {self.table: [(f.name, logical.logical_type(f), []) for f in self.fields]})
        return Files(task.partitionId(), made)

    def commit(self, messages: list[Files]) -> None:
        files, folder = _open(self.path)
        known = [] if self.overwrite else _listed(files, folder)
        known += [x for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for x in m.files]
        with files.open_output_stream(f"{folder}/{LIST}.part") as out:
            out.write("".join(f"{rows} {name}\n" for name, rows in known).encode())
        files.move(f"{folder}/{LIST}.part", f"{folder}/{LIST}")

    def abort(self, messages: list[Files]) -> None:
        files, folder = _open(self.path)
        for name, _ in (x for m in messages if m is not None for x in m.files):
            files.delete_file(f"{folder}/{name}")


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _listed(files: pyarrow.fs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """(file, rows) of a folder's list; none where there is no folder."""
    if files.get_file_info(f"{folder}/{LIST}").type == pyarrow.fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{folder}/{LIST}") as source:
        return [(name, int(rows)) for rows, _, name in (x.partition(" ") for x in source.read().decode().splitlines())]


class ContainerSource(DataSource):
    """spark.read.format("container").option("table", name).load(path): rows with `_pos`.

    A schema with fewer columns reads only those. A path is a file or a folder that was
    written by df.write.format("container").option("table", name).save(folder), whose files
    have `rows` rows at most; mode append adds files. Several files given by name, with
    commas between, each count from 0.
    """

    @classmethod
    def name(cls) -> str:
        return "container"

    def _files(self) -> list[OneFile]:
        found: list[OneFile] = []
        for path in (p for p in self.options["path"].split(",") if p):
            files, folder = _open(path)
            if files.get_file_info(folder).type != pyarrow.fs.FileType.Directory:
                found.append(OneFile(path))
                continue
            first = 0
            for name, rows in _listed(files, folder):
                found.append(OneFile(f"{path.rstrip('/')}/{name}", first))
                first += rows
        if not found:
            raise ContainerError(f"{self.options['path']} holds no container")
        return found

    def schema(self) -> T.StructType:
        return _spark_schema(read_file(self._files()[0].path), self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ContainerReader(self._files(), self.options["table"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ContainerWriter(self.options["path"], self.options["table"], schema, int(self.options.get("rows", FILE_ROWS)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
