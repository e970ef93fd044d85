"""File sources and sinks (S1-S9).  Explicit schemas everywhere
(``inferSchema`` only as an opt-in fallback), one partitioned table instead
of many files, corrupt JSON records routed to a side table."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = (".csv", ".parquet", ".json")


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Load by extension.  CSV uses the header and the given schema
    (inference only when no schema is given); Excel has no Spark source and
    is refused with the reference's message — export it to CSV/Parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".xlsx", ".xls"):
        raise ValueError(f"Unsupported file format: {ext} (no Spark Excel source; export to CSV or Parquet)")
    if ext in (".csv", ""):              # a path without an extension is a folder of CSV files
        r = spark.read.option("header", True).option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext == ".json":
        return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    raise ValueError(f"Unsupported file format: {ext}")


def read_many_csv(spark: SparkSession, root: str, schema, glob: str = "*.csv") -> DataFrame:
    """S3: every file under ``root`` matching ``glob`` in one scan, with the
    source file name for per-file profiling."""
    df = (spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .schema(schema).csv(root))
    return df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


FEEDBACK_SCHEMA = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("prediction_class", T.StringType()),
    T.StructField("prediction_probability", T.StringType()),
    T.StructField("diagnostic_accuracy", T.StringType()),
    T.StructField("usefulness_rating", T.StringType()),
    T.StructField("actual_diagnosis", T.StringType()),
    T.StructField("other_diagnosis", T.StringType()),
    T.StructField("comments", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("patient_data", T.StructType([
        T.StructField("age", T.DoubleType()), T.StructField("gender", T.IntegerType()),
        T.StructField("prediction", T.DoubleType()), T.StructField("prediction_class", T.StringType()),
        T.StructField("probability", T.DoubleType()), T.StructField("contains_outliers", T.BooleanType())])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_feedback_json(spark: SparkSession, path: str, corrupt_path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """JSON feedback folder, one indented object or an array of them per file (or, without ``multi_line``, one per line), explicit schema.
    Corrupt records are appended to the Parquet table ``corrupt_path``; returns (clean records, that table)."""
    df = (spark.read.schema(FEEDBACK_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("recursiveFileLookup", True)
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    df.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record", "report_id", F.input_file_name().alias("file")).write.mode("append").parquet(corrupt_path)
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), spark.read.parquet(corrupt_path)


RECORDS = 1_000  # of a file that holds an array of records


def append_json(df: DataFrame, path: str) -> None:
    """Append records as indented JSON, each file an array of at most ``RECORDS``: files grow with the records' bytes, not with their number."""
    def arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": ["[\n" + ",\n".join(frame["value"].iloc[k:k + RECORDS]) + "\n]" for k in range(0, len(frame), RECORDS)]})

    record = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    # a file's text is one value, so that each file is one JSON document
    df.select(record.alias("value")).mapInPandas(arrays, "value string").write.mode("append").option("maxRecordsPerFile", 1).text(path)


def write_split_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by split (not four files)."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
