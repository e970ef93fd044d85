"""Type narrowing plans.

The plan is derived lazily from ONE aggregate row (min/max per integer
column, distinct ratio per string column, decimals and range per float
column) and is itself a small DataFrame — one row per column.  Spark has no
unsigned, half or category type: unsigned ranges map to the next signed type
that fits, half to float, category to string (Parquet dictionary-encodes it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import stack_long

# Storage width in bytes per value, by type name.
WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
         "decimal(20,0)": 16, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1, "date": 4}
# reference type name -> Spark type that holds its range
SPARK_OF = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
            "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
            "float32": "float", "float16": "float", "float64": "double", "category": "string", "object": "string"}
INT_TYPES = ("tinyint", "smallint", "int", "bigint")
FLOAT_TYPES = ("float", "double")


# Integer types with the range each holds, smallest first: unsigned ones for columns without negatives; signed lower bounds are strict.
UNSIGNED = [("uint8", 2 ** 8), ("uint16", 2 ** 16), ("uint32", 2 ** 32), ("uint64", None)]
SIGNED = [("int8", 2 ** 7), ("int16", 2 ** 15), ("int32", 2 ** 31), ("int64", None)]


def _int_rule(mn, mx) -> str:
    return next(name for name, top in (UNSIGNED if mn >= 0 else SIGNED) if top is None or (mx < top and (mn >= 0 or mn > -top)))


LONG_VALUE = 64


def _distinct_counts(df: DataFrame, cols: list[str]) -> dict:
    """{column: number of distinct non-null values} of text columns."""
    if not cols:
        return {}
    short = F.when(F.octet_length("value") > LONG_VALUE, F.concat(F.lit("#"), F.sha2("value", 256))).otherwise(F.concat(F.lit("="), "value"))
    pairs = stack_long(df, cols, "string").where(F.col("value").isNotNull()).groupBy("column", short.alias("value")).agg(F.lit(1).alias("one"))
    return {r["column"]: r["n"] for r in pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


PLAN_SCHEMA = ("column string, original_type string, new_type string, spark_type string, bytes_before bigint, "
               "bytes_after bigint, saved_bytes bigint, pct_zero double, sparse_candidate boolean")


def narrowing_plan(df: DataFrame, aggressive: bool = False, exclude: list[str] | tuple = ()) -> DataFrame:
    """D18 (and D19 when ``aggressive``): (column, original_type, new_type,
    spark_type, bytes_before, bytes_after, saved_bytes, pct_zero,
    sparse_candidate).  All statistics but distinct counts come from ONE aggregate
    over the table; distinct values of text columns are counted as (column, value)
    pairs, combined before the shuffle, with a digest in place of a long value.  The per-column rule is
    then applied to that single row."""
    types = {c: t for c, t in df.dtypes if c not in exclude}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c, t in types.items():
        x = F.col(c)
        if t in INT_TYPES + FLOAT_TYPES:
            aggs += [F.min(x).cast("double").alias(f"{c}__mn"), F.max(x).cast("double").alias(f"{c}__mx"),
                     F.count_if(x == 0).alias(f"{c}__z")]
        if t in FLOAT_TYPES and aggressive:
            aggs.append(F.max(F.length(F.split_part(x.cast("string"), F.lit("."), F.lit(2)))).alias(f"{c}__dec"))
        elif t == "string":
            aggs.append(F.sum(F.octet_length(x)).alias(f"{c}__len"))
    row = df.agg(*aggs).collect()[0]
    distinct = _distinct_counts(df, [c for c, t in types.items() if t == "string"])
    rows = row["_rows"]
    out = []
    for c, t in types.items():
        if t in INT_TYPES:
            mn, mx = row[f"{c}__mn"], row[f"{c}__mx"]
            new = _int_rule(mn, mx) if mn is not None else t
        elif t in FLOAT_TYPES:
            if aggressive:
                dec, mn, mx = row[f"{c}__dec"], row[f"{c}__mn"], row[f"{c}__mx"]
                new = ("float16" if dec is not None and dec <= 3 and mn > -65500 and mx < 65500
                       else "float32" if dec is not None and dec <= 7 else "float64")
            else:
                new = "float32"
        elif t == "string":
            new = "category" if rows and distinct.get(c, 0) / rows < 0.5 else "object"
        else:
            new = t
        spark_t = SPARK_OF.get(new, new)
        if t == "string":
            before = row[f"{c}__len"]
            after = rows * 4 if new == "category" else before
        else:
            before = rows * WIDTH.get(t, 8)
            after = rows * WIDTH.get(spark_t, 8)
        zero = row[f"{c}__z"] * 100.0 / rows if t in INT_TYPES + FLOAT_TYPES and rows else None
        saved = None if before is None or after is None else before - after
        out.append((c, t, new, spark_t, before, after, saved, zero, bool(zero is not None and zero > 50)))
    return df.sparkSession.createDataFrame(out, PLAN_SCHEMA)


def narrowing_report(plan: DataFrame, top: int = 15) -> DataFrame:
    """Rows sorted by saved size (tie: name), top ``top``."""
    return plan.orderBy(F.desc("saved_bytes"), "column").limit(top)


def apply_narrowing(df: DataFrame, plan: DataFrame, drop: list[str] | tuple = ()) -> DataFrame:
    """Cast per the plan (collects one row per column)."""
    m = {r["column"]: r["spark_type"] for r in plan.select("column", "spark_type").collect()}
    return df.select(*[F.col(c).cast(m[c]).alias(c) if c in m else F.col(c) for c in df.columns if c not in drop])


def savings_summary(plan: DataFrame) -> DataFrame:
    """D19 summary row: total bytes before/after and the ratio."""
    return plan.agg(F.sum("bytes_before").cast("bigint").alias("bytes_before"),
                    F.sum("bytes_after").cast("bigint").alias("bytes_after"),
                    (F.sum("bytes_before") / F.sum("bytes_after")).alias("ratio"),
                    F.count_if(F.col("sparse_candidate")).alias("n_sparse"))
