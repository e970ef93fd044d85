"""Idempotent ingestion of report files.

A table has three parts: ``rows`` (the reports, in the order of days: as many files as their bytes need, however many days there are), ``corrupt`` (unreadable records, once) and ``ledger`` (path, length and time of every file read).
An ingest lists the files, removes those that the ledger holds, reads the others, and notes them last.  A run that fails is repeated under its own number
and overwrites itself; a run without new files adds nothing.  A file that changed is read again, and ``latest`` lets the last version of a report count.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .registry import path_exists

LEDGER = "path string, length long, modificationTime timestamp"
PATHS = 10_000  # of new files, that one read names


def append_records(df: DataFrame, root: str, day) -> None:
    """S8 for many records: JSON lines under one folder a day, a file a day (a day of very many records is several)."""
    df.withColumn("_day", day).hint("rebalance", "_day").write.mode("append").partitionBy("_day").option("ignoreNullFields", False).json(root)


def _part(spark: SparkSession, table: str, part: str, schema) -> DataFrame:
    """All batches of a part that were noted; none where there is none."""
    noted = _noted(spark, table)
    if not noted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{table}/{part}").parquet(*[f"{table}/{part}/batch={n}" for n in noted])


def _noted(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the finished batches; they are given in order."""
    out = 0
    while path_exists(spark, f"{table}/ledger/batch={out}/_SUCCESS"):
        out += 1
    return list(range(out))


def new_files(spark: SparkSession, source: str, table: str) -> DataFrame:
    """(path, length, modificationTime) of files that no finished batch has read; contents are not touched."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", "modificationTime")
    return listed.join(_part(spark, table, "ledger", LEDGER).select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def ingest(spark: SparkSession, source: str, table: str, schema, day, multi_line: bool = True) -> int:
    """Read what is new under ``source`` into ``table``; ``day`` is the report's day as a column.  Returns the number of files read.

    ``schema`` has a ``_corrupt_record`` column; files hold one indented object each (``multi_line``) or one a line."""
    files = written(new_files(spark, source, table), "new-files")
    if files.isEmpty():
        return 0
    number, read = len(_noted(spark, table)), 0
    paths = (r["path"] for r in files.select("path").toLocalIterator())
    for k in itertools.count():  # the list of paths reaches the driver a slice at a time
        some = list(itertools.islice(paths, PATHS))
        if not some:
            break
        read += len(some)
        rows = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(some)
                .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived")))
        rows = written(rows, "parsed")  # parsed once, for both parts
        mode = "overwrite" if k == 0 else "append"
        good = rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumn("day", day)
        good.repartitionByRange("day").sortWithinPartitions("day").write.mode(mode).parquet(f"{table}/rows/batch={number}")
        rows.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record", "file").write.mode(mode).parquet(f"{table}/corrupt/batch={number}")
    files.write.mode("overwrite").parquet(f"{table}/ledger/batch={number}")
    return read


def reports(spark: SparkSession, table: str) -> DataFrame:
    """Every report version read so far, with its file, arrival, day and batch."""
    return spark.read.option("basePath", f"{table}/rows").parquet(*[f"{table}/rows/batch={n}" for n in _noted(spark, table)])


def corrupt(spark: SparkSession, table: str) -> DataFrame:
    return _part(spark, table, "corrupt", "_corrupt_record string, file string, batch int")


def latest(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """The last version of every report: by arrival, then by file name."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("arrived", "file")).alias("v")).select(key, "v.*")


def compact(spark: SparkSession, table: str) -> str:
    """The same table with all batches in one, in the order of days: what very many small ingests are folded into.  Returns its folder."""
    target = scratch_path(spark, "compacted")
    reports(spark, table).drop("batch").repartitionByRange("day").sortWithinPartitions("day").write.parquet(f"{target}/rows/batch=0")
    corrupt(spark, table).drop("batch").write.parquet(f"{target}/corrupt/batch=0")
    _part(spark, table, "ledger", LEDGER).write.parquet(f"{target}/ledger/batch=0")
    return target
