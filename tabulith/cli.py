"""convert and describe on the command line; both return an exit code."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import choice, describe
from tabulith.operators.position import POS
from tabulith.sources import container, text
from tabulith.sources.store import Store

# File name endings and the formats they stand for.
ENDINGS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc", ".container": "container"}
FORMATS = ("csv", "parquet", "container", "store", "json", "orc")


def format_of(path: str) -> str:
    """The format that a path's ending stands for, in any case; a folder without one is a store."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    return ENDINGS.get(ending, "store" if not ending else "unknown")


def source_format(path: str) -> str:
    """The format of what is at path: by its ending or, where that says nothing, by its first bytes."""
    kind = format_of(path)
    if kind != "unknown" or "://" in path or not os.path.isfile(path):
        return kind
    with open(path, "rb") as file:
        return "container" if file.read(len(container.MAGIC)) == container.MAGIC else kind


def _placed(df: DataFrame) -> DataFrame:
    """Rows numbered as they stand in a file: by its name and their place in it."""
    return df.withColumn(POS, F.monotonically_increasing_id())


def read_tables(spark: SparkSession, path: str, kind: str) -> dict[str, tuple[DataFrame, str]]:
    """The tables of a source, each with the column that orders it."""
    if kind == "csv":
        return {"CSVTable": (_placed(text.read_csv(spark, path)), POS)}
    if kind in ("parquet", "json", "orc"):
        return {os.path.splitext(os.path.basename(path.rstrip("/")))[0]: (_placed(spark.read.format(kind).load(path)), POS)}
    if kind == "container":
        container.register(spark)
        names = container.read_file(path).tables
        return {n: (spark.read.format("container").option("table", n).load(path), POS) for n in names}
    if kind == "store":
        store = Store(spark, path)
        return {n: (df if POS in df.columns else _placed(df), POS) for n in store.names() for df in [store.table(n)]}
    raise ValueError(f"{path}: unknown format")


def write_tables(tables: dict[str, tuple[DataFrame, str]], path: str, kind: str, multiple: bool = False, encodings: dict | None = None) -> None:
    """Write tables to a target; formats of one table a file get `{stem}_{table}{ending}` names or, for CSV, a folder."""
    stem, ending = os.path.splitext(path)
    bare = {n: (df.drop(POS), order) for n, (df, order) in tables.items()}
    if kind == "csv" and not multiple:
        text.write_lines(text.csv_tables(tables), path, "table_no", "line_no")
    elif kind == "csv":
        for name, (df, order) in tables.items():
            text.write_lines(text.csv_lines(df, order), f"{stem}/{name}.csv", "line_no")
    elif kind in ("parquet", "json", "orc"):
        for name, (df, _) in bare.items():
            df.write.mode("overwrite").format(kind).save(f"{stem}_{name}{ending}")
    elif kind == "container":
        container.export({n: (df, order) for n, (df, order) in tables.items()}, path, encodings=encodings)
    elif kind == "store":
        spark = next(iter(tables.values()))[0].sparkSession
        for name, (df, _) in tables.items():
            Store(spark, path).write(name, df, "overwrite", sort_by=POS)
    else:
        raise ValueError(f"{path}: unknown format")


def convert(spark: SparkSession, source: str, target: str, from_: str | None = None, to: str | None = None, multiple: bool = False, encodings: dict | None = None) -> None:
    tables = read_tables(spark, source, from_ or source_format(source))
    if tables:
        write_tables(tables, target, to or format_of(target), multiple, encodings)


#: Widths of the columns of header(): name, encoding, type, id, parent, facts.
WIDTHS = (10, 11, 7, 3, 8, 50)


def header(file: container.File, widths: tuple[int, ...] = WIDTHS) -> list[str]:
    """A line for each table, column and node of a container: encoding, type, id, parent and facts."""
    n, e, t, i, p, b = widths
    lines = []

    def walk(node: container.Part, name: str) -> None:
        facts, about = "", container.Cursor(node.blob)
        if node.encoding == "Binary":
            facts = f"{about.number('i')} bytes at {about.number('q')}"
        elif node.encoding == "BitPacking":
            facts = f"prefix of {about.number('B')} bits, {about.number('Q')}"
        elif node.encoding == "Table":
            names = []
            while not about.done():
                names.append(about.string())
            facts = ", ".join(names)
        lines.append(f"| {name:{n}} | {node.encoding:{e}} | {node.logical:{t}} | {node.id:{i}} | {node.parent:{p}} | {facts:{b}} |")
        for part in node.parts:
            walk(part, "")

    for table, (root, columns) in file.tables.items():
        names = {id(node): n for n, node in columns.items()}
        lines.append(f"## {table}")
        walk(replace(root, parts=[]), table)
        for part in root.parts:
            walk(part, names.get(id(part), ""))
    return lines


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulith")
    verbs = parser.add_subparsers(dest="verb", required=True)
    c = verbs.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--from", dest="from_", choices=FORMATS)
    c.add_argument("--to", choices=FORMATS)
    c.add_argument("-m", "--multiple", action="store_true")
    c.add_argument("-b", "--bit-packing", action="store_true")
    c.add_argument("-s", "--split", action="store_true", help="plain columns, text as lengths and bytes, unless other encodings are named too")
    c.add_argument("-r", "--run-length", action="store_true")
    c.add_argument("-v", "--verbose", action="store_true", help="print what is written")
    d = verbs.add_parser("describe")
    d.add_argument("source")
    d.add_argument("-f", "--file", action="store_true", help="values too")
    d.add_argument("-c", "--rows", type=int, default=15)
    d.add_argument("-d", "--width", type=int, default=12)
    for short, name, width in zip("netipb", ("name", "encoding", "type", "id", "parent", "facts"), WIDTHS, strict=True):
        d.add_argument(f"-{short}", f"--{name}-width", type=int, default=width)
    d.add_argument("-l", "--limit", action="store_true", help="only as many columns as a line of the screen holds")
    d.add_argument("--no-header", action="store_true")
    found = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        if found.verb == "convert":
            wanted = [n for n, on in (("BitPacking", found.bit_packing), ("RunLength", found.run_length)) if on]
            encodings = {n: choice.ENCODINGS[n] for n in wanted} if wanted or found.split else None
            convert(spark, found.source, found.target, found.from_, found.to, found.multiple, encodings)
            if found.verbose:
                print(f"{found.source} -> {found.target}, encodings: {'all' if encodings is None else ', '.join(['Split', *wanted])}")
            return 0
        kind = source_format(found.source)
        if kind == "container":
            file = container.read_file(found.source)
            if not found.no_header:
                print("\n".join(header(file, tuple(getattr(found, f"{x}_width") for x in ("name", "encoding", "type", "id", "parent", "facts")))))
            line = shutil.get_terminal_size().columns if found.limit else None
            for name in file.tables if found.file else ():
                print(describe.leaves_text(file, name, found.rows, found.width, line))
        else:
            for name, (df, order) in read_tables(spark, found.source, kind).items():
                print(describe.preview_text(df, name, order, found.rows, found.width))
        return 0
    except (ValueError, OSError) as error:
        print(f"{found.verb}: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
