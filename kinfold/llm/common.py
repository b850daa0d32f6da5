"""Helpers that the corpus operators share: table access, shared storage, text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are worked on in slices of so many text bytes, so that very long texts don't add up.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def own_dir() -> str:
    """A folder of this process, for local masters."""
    return "file://" + tempfile.mkdtemp(prefix="kinfold-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = own_dir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/kinfold/{label}-{uuid.uuid4().hex}"


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores after it until no taken column has it (Spark doesn't tell upper from lower case)."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Give memory that is free back to the system, as workers live on after their task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


#: Rows of an Arrow batch while a stage table is written: whole rows pass through Python with large arrays beside them.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
#: Whether an execution's shuffle files go when it ends, rather than when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are of no more use once it is done, so they are dropped then. The session's options
    are what they were afterwards.
    """
    session = df.sparkSession
    path, before = new_path(session, label), {CLEANUP: session.conf.get(CLEANUP, "false"), BATCH: session.conf.get(BATCH)}
    session.conf.set(CLEANUP, "true")
    session.conf.set(BATCH, ROWS)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            session.conf.set(key, value)
    return session.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Drop a table that materialize() has written, once nothing reads it any more."""
    session = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/kinfold/" in path:
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about limit bytes of the column (one row at least).

    Spark's own batches hold at most spark.sql.execution.arrow.maxBytesPerBatch, or one row.
    """
    for batch in batches:
        n = batch.num_rows
        sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start, held = 0, 0
        for i in range(n):
            if i > start and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += sizes[i]
        if start < n:
            yield batch.slice(start, n - start)
        release()
