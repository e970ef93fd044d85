"""One-pass column statistics: every per-column aggregate of a request is
built into a single ``agg`` (partial aggregation per task, one tiny final
merge).  Only one row per column reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATS = {
    "count": lambda c: F.count(c),
    "n_null": lambda c: F.count(F.lit(1)) - F.count(c),
    "mean": lambda c: F.avg(c),
    "std_samp": lambda c: F.stddev_samp(c),
    "std_pop": lambda c: F.stddev_pop(c),
    "var_samp": lambda c: F.var_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "n_zero": lambda c: F.count_if(c == 0),
    "n_distinct": lambda c: F.count_distinct(c),
    "approx_distinct": lambda c: F.approx_count_distinct(c),
}


def stat_exprs(cols: list[str], stats: list[str]) -> list[Column]:
    return [_STATS[s](F.col(c)).alias(f"{c}__{s}") for c in cols for s in stats]


def column_stats(df: DataFrame, cols: list[str], stats: list[str], extra: list[Column] = ()) -> dict:
    """{col: {stat: value}} (+ '__rows' and named extras) from one job."""
    if not cols and not extra:
        return {"__rows": df.count()}
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *stat_exprs(cols, stats), *extra).collect()[0].asDict()
    out = {c: {s: row[f"{c}__{s}"] for s in stats} for c in cols}
    out["__rows"] = row["__rows"]
    for k, v in row.items():
        if "__" not in k or k == "__rows":
            out[k] = v
    return out


def modes(df: DataFrame, cols: list[str]) -> dict:
    """{col: most frequent non-null value}; ties -> smallest value (pandas
    ``mode()[0]``).  One scan per type family: columns are stacked to
    (column, value) — numeric as double, others as string so each family
    keeps its own order — value-counted with map-side combine, then
    ``min(struct(-count, value))`` per column.  Never a whole column in one
    aggregation buffer."""
    if not cols:
        return {}
    from pyspark.sql import types as T
    fields = {f.name: f.dataType for f in df.schema.fields}
    fams = {"double": [c for c in cols if isinstance(fields[c], T.NumericType)],
            "string": [c for c in cols if not isinstance(fields[c], T.NumericType)]}
    got = {}
    for typ, cs in fams.items():
        if not cs:
            continue
        parts = ", ".join(f"'{c}', CAST(`{c}` AS {typ})" for c in cs)
        long = df.selectExpr(f"stack({len(cs)}, {parts}) AS (column, value)").where(F.col("value").isNotNull())
        vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
        best = vc.groupBy("column").agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("value").alias("v"))).alias("b"))
        got.update({r["column"]: r["v"] for r in best.select("column", F.col("b.v").alias("v")).collect()})
    types = dict(df.dtypes)
    res = {}
    for c in cols:
        v = got.get(c)
        if v is None:
            res[c] = None
        elif types[c] in ("int", "bigint", "smallint", "tinyint"):
            res[c] = int(v)
        elif types[c] in ("double", "float") or types[c].startswith("decimal"):
            res[c] = float(v)
        else:
            res[c] = v
    return res
