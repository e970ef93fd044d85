"""Query registry: each entry pairs a Spark query ``(spark, sf_dir) ->
DataFrame`` with an optional DuckDB oracle SQL text over the driver tables.

Double columns are rounded to 6 places on both sides (``+ 0.0`` folds -0.0)
so that last-digit float noise does not decide a comparison.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 6


@dataclass
class Query:
    name: str
    fn: Callable
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    family: str = ""

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        # Spark rounds a double through its decimal string (HALF_UP); do the
        # same in DuckDB so that near-ties round identically.
        rep = ", ".join(
            f'CASE WHEN isfinite("{c}") THEN CAST(round(CAST(CAST("{c}" AS VARCHAR) AS DECIMAL(38,17)), {PLACES}) '
            f'AS DOUBLE) + 0.0 ELSE "{c}" END AS "{c}"' for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) q"

    def run(self, spark, sf_dir: str) -> DataFrame:
        return round_doubles(self.fn(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | tuple = (), family: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, list(doubles), family)
        return fn
    return deco


def round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), PLACES) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
