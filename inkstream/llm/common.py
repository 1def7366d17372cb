"""Shared helpers: table access, scratch tables in the cluster's shared folder, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.plans.views import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a DataFrame; a small file's rows are dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back when its task ends; workers outlive tasks and would hold their peak."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def text_batches(spark: SparkSession) -> None:
    """Bound the bytes and rows of an Arrow batch for this session: texts are long, and a worker holds a batch and what it makes of it at a time.

    Plans read the settings when they run, so they can't be put back here; they are only ever lowered.
    """
    conf = spark._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < conf.arrowMaxRecordsPerBatch() <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.

    Only where neither is set and all workers run on this machine (``local`` masters, as in tests), a temporary folder
    of this process is made and remembered in the session. On a cluster that is an error: parts that executors
    write to folders of their own would be missed without a word.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("inkstream.shared.dir", None)
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkstream-")
        spark.conf.set("inkstream.shared.dir", path)
    return path.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    """Delete this process's scratch tables; results that were not written by now can't be read any more anyway."""
    for spark, path in _scratch:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
                _delete(spark, path)


atexit.register(_sweep)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/inkstream-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a Parquet table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    root = shared_dir(spark)
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/inkstream-" in folder and root.split("://")[-1].lstrip("/") in folder:
                _delete(spark, folder)


def utf8(col: str) -> F.Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
