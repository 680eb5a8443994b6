"""Shared helpers: the shared folder, written tables and Arrow batch maps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of whitespace that separate words: [\x20\x09-\x0D], the set bytes.split() uses.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of an Arrow batch (a longer row is a batch of its own), and of what a function takes at once.
BATCH_BYTES = 1 << 22
PART_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session (tests) without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusmill-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: The paths that written() made within scratch(), or None outside.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that written() made inside; what is returned from inside must be written elsewhere first."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        _delete(spark, made)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The shuffle files behind it go once it is written. Inside scratch() the table
    goes at its end, unless it stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None and not stays:
        made.append(path)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table_ in tables:
        _delete(table_.sparkSession, {f.rpartition("/")[0] for f in table_.inputFiles()})


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold BATCH_BYTES at most from now on, where nothing else is set.

    Ten thousand long texts in one batch, times the tasks and copies of an executor, are what its memory wouldn't bear.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trimmed()

    return df.mapInArrow(run, schema)


def trimmed() -> None:
    """Gives a worker's free memory back to the system; workers are used again, and several stay beside an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def parts(batch: pa.RecordBatch, column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most limit bytes of one string column (a longer value is a slice of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    return column.cast(pa.binary()).to_pylist()


def free(name: str, *taken: str) -> str:
    """A column name like this one that isn't taken (names differ in more than case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
