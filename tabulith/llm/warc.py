"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

An archive file starts with a skippable frame that holds the dictionary, trained on
records of that file, or where they are too few or too alike for training, the beginnings
of its records as they are; then each record is a frame by itself. Of records with equal
payloads of at least REVISIT_BYTES bytes one is a response and the others are revisits
that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import file_system, fresh_path, picked, use_worker, written

#: Bytes from which equal payloads are stored once.
REVISIT_BYTES = 1000
#: Bytes of records in a file, of its dictionary, and of the records that the dictionary is trained on; level of compression.
FILE_BYTES, DICTIONARY_BYTES, TRAINED_BYTES, LEVEL = 16 << 20, 64 << 10, 2 << 20, 3
#: The number that starts the frame of a dictionary in a WARC file, and the profile of a revisit.
SKIPPABLE, PROFILE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time of capture that is written where the input has none.
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'url:{url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of page refers_to. digest: hex SHA-1 of the payload.

    Page ids are kept in extension fields, which other readers pass over; the length of
    the full payload is the Content-Length of the HTTP head, also in a revisit.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", NO_DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, None)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of a file: the dictionary's frame, and a frame for each record; none without records."""
    if not records:
        return b""
    total = sum(map(len, records))
    step, size = max(1, -(-total // TRAINED_BYTES)), min(DICTIONARY_BYTES, max(1024, total // 10))
    try:
        dictionary = zstandard.train_dictionary(size, records[::step], level=LEVEL)
    except zstandard.ZstdError:  # too few records, or too alike
        dictionary = zstandard.ZstdCompressionDict(b"".join(r[:512] for r in records[: size // 512]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    raw = dictionary.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(packer.compress, records))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields, with names in lower case, and the block of each record of a file."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if raw[:4] == zstandard.FRAME_HEADER:  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        at, dictionary = 8 + size, zstandard.ZstdCompressionDict(raw)
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[at:]), read_across_frames=True), 1 << 20)
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = source.read(length)
        if len(block) != length or source.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def page(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's payload must have its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    number = lambda x: int(fields[x]) if x in fields else None
    return number("x-page-id"), length, digest, kind, number("x-refers-to-page-id")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write pages(page_id, url, html) to archives under path; gives file and records of each.

    path is in a file system that pyarrow.fs reaches from all executors. A null html is an
    empty payload, a null url has no target; rows with a null page_id are written without
    one. Of equal payloads of at least REVISIT_BYTES bytes the largest page_id is the
    response; rows that share that page_id are all responses. Files of a task that ran
    twice have different names; only those in the returned table count. Empty input gives
    no files. Other columns are left out.
    """
    rows = picked(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # small payloads are not looked up, and go to any partition
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 16)))))
    firsts = rows.where(large).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("key", "first_id")
    refers = F.when((F.col("first_id") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first_id"))
    rows = rows.join(firsts, "key", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("warc")
        files, folder = file_system(path)
        files.create_dir(folder, recursive=True)
        task, made = TaskContext.get(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal made, size
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(archive(held))
            made += 1
            batch = pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([len(held)], pa.int64())})
            held.clear()
            size = 0
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(record(*(batch.column(k)[i].as_py() for k in range(5))))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return written(rows.mapInArrow(run, "file string, records long"), "manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of manifest(file) under path."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("warc")
        files, folder = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    rows = [page(*x) for x in parse(source.read())]
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # one task a file, as far as there are not very many
    tasks = min(max(manifest.count(), 1), 100_000)
    return manifest.select("file").repartition(tasks).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_archives() of archives of all pages."""
    path = fresh_path(spark, "warc")
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path), path)
