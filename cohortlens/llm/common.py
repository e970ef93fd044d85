"""Helpers shared by the text operators: shared-folder tables and Arrow maps."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir, exchanges_dropped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the folder named by ``spark.checkpoint.dir`` and
    read it back: lineage ends there and every executor sees the files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with exchanges_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(col):
    """The text's UTF-8 bytes; null gives null."""
    return F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")


def text_slices(batch, column: int, max_bytes: int):
    """Split an Arrow batch into row ranges whose binary column holds at most
    ``max_bytes`` (one row at least), so that array temporaries stay bounded."""
    col = batch.column(column)
    start, size = 0, 0
    for i in range(batch.num_rows):
        n = len(col[i].as_buffer()) if col[i].is_valid else 0
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def sheltered(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names set aside under others, and the names to put back."""
    aside = {c: f"__aside_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(aside), {v: k for k, v in aside.items()}


_RESIDENT: dict = {}


def resident(key, make):
    """What a Python worker keeps between tasks: the one value made last.  A task with another key replaces it, so that a worker
    never holds the tables of several operators."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let whole texts reach Python in batches of at most ``ARROW_ROWS`` rows (Spark's default of 10,000 texts takes tens of MB on both sides)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def give_back() -> None:
    """Return freed memory to the system: workers stay for the next stage, and an executor's tasks share one limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function that gives memory back when its task ends."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def tidy_group(run):
    """A function of one group that gives memory back after every group."""
    def wrapped(table):
        out = run(table)
        give_back()
        return out
    return wrapped


def tidy_pair(run):
    """A function of two grouped tables that gives memory back after every group."""
    def wrapped(left, right):
        out = run(left, right)
        give_back()
        return out
    return wrapped
