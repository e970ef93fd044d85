"""Driver tables and load-time normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """pandas skips NaN in statistics, Spark only skips NULL: turn every NaN in
    floating columns into NULL once, at load."""
    fl = [f.name for f in df.schema.fields
          if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)]
    if not fl:
        return df
    return df.select(*[
        F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fl else F.col(c)
        for c in df.columns])


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """Columns of a numeric Spark type (P2 select-by-dtype)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def column_difference(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns of ``before`` that ``after`` lacks, in their order."""
    return [c for c in before.columns if c not in after.columns]
