"""Token-ID files: Parquet list columns that can be read in part.

Layout: files in ascending doc_id order. Columns: doc_id; part, the number of the file
in that order; start_in_part, ids in the file before this document; n_tokens; ids
list<int>. Version 2 data pages hold dictionary codes for ids (the plain form is used
past the dictionary's size) and delta-packed integers for the rest; row groups and
pages have set sizes, and the writer adds page indexes, so that a filter on doc_id
skips pages and a read of the lengths never touches the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import documents, file_system, fresh_path, picked, use_worker
from tabulith.llm.tokenizing import encoder, slices

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Documents that a reader of ids holds at once.
BATCH_ROWS = 2000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode docs(doc_id, text) and write the files of the layout above to path.

    A null text counts as empty: it gets end_id alone. Repeated doc_ids stay, next to
    each other, in the order of their texts' hashes; null doc_ids come first. Empty input
    gives files without rows. Other columns are left out, whatever their names.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("token files")
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, keeps_blanks=True)
        for batch in batches:
            row = 0
            for texts in slices(batch.column(1)):
                ids, ends = enc.encode(texts, end_id)
                n = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), lists],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                row += len(texts)
                at += len(ids)

    ordered = (
        picked(docs, "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "hash", "row")  # rows with one doc_id, or without, are not one task
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )
    # numbers without a dictionary are delta-packed in version 2 pages
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "start_in_part", "n_tokens")}
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.options(**plain)
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def token_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens: the ids themselves are not read."""
    return spark.read.schema(SCHEMA).parquet(path).drop("ids")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids, of doc_ids from first to last where given; the filter reaches the pages."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, offset: ids in all files before it. One row a file."""
    sums = token_lengths(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("offset"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A task reads a file at a time, batch by batch, through pyarrow.fs, so the ids go from
    the pages to numpy without becoming rows in between.
    """
    out = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("token files")
        for file in (x for batch in batches for x in batch.column(0).to_pylist()):
            files, place = file_system(file)
            with files.open_input_file(place) as source:
                for rows in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=["doc_id", "part", "start_in_part", "ids"]):
                    ids = rows.column("ids")
                    raw, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), rows.column("part"), rows.column("start_in_part"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                        names=[x.split()[0] for x in out.split(", ")],
                    )

    files = spark.read.schema(SCHEMA).parquet(path).inputFiles()
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    # one row a file: bounded by the number of write tasks
    return named.mapInArrow(digest, out).join(F.broadcast(part_offsets(spark, path)), "part").select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_digests() of files of all documents, each with id 0 at its end."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path)
