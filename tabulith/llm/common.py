"""What the operators of this subpackage share: folders, written tables, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a whole URI.

    It is the one the session names in spark.checkpoint.dir. Only where that is unset and
    all runs on one machine is a folder of our own made, one an application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='tabulith-')}"
            spark.sparkContext.setCheckpointDir(_own[app])
        named = _own[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames from written() that no later plan reads."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns with exactly these names, also where other columns' names differ from them in case alone."""
    return numbered(df).select(*[F.col(f"_{df.columns.index(x)}").alias(x) for x in names])


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places (_0, _1 ...), so that no two names clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, under the name that Arrow has for its scheme, and the path in it."""
    scheme, _, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


#: Schemes of Hadoop's file systems that Arrow calls otherwise.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_user = ""


def use_worker(user: str) -> None:
    """Called as a task of an operator starts: what another operator remembered in this worker goes.

    Spark keeps Python workers for later tasks, and with them all memos and models. Modules
    that remember something put the function that forgets it into FORGET.
    """
    global _user
    if user == _user:
        return
    if _user:
        for forget_ in FORGET:
            forget_()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _user = user


#: Functions that drop what a module remembers in a worker.
FORGET: list[Callable[[], None]] = []


def text_runs(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about most_bytes each, so that what is held at once stays bounded."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // most_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(texts)]]).tolist() if len(texts) else []
    yield from zip(cuts[:-1], cuts[1:], strict=False)
