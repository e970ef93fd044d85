"""Missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantile_dict, stack_long
from ..functions.stats import column_stats, modes
from ..sources.tables import numeric_columns


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_null, pct_null) for every column, one pass."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in cols])
    st = stack_long(row, cols, value_type="bigint", keep=["_rows"], value_col="n_null")
    return st.select("column", "n_null",
                     (F.col("n_null") * 100.0 / F.col("_rows")).alias("pct_null"))


def missing_report(df: DataFrame) -> DataFrame:
    """A3: columns with nulls, % desc, with the advice band."""
    nc = null_counts(df).where(F.col("n_null") > 0)
    adv = (F.when(F.col("pct_null") > 50, "Consider dropping this column")
           .when(F.col("pct_null") > 20, "Impute using advanced methods (KNN, MICE)")
           .otherwise("Impute using median/mode"))
    return nc.select("column", "n_null", "pct_null", adv.alias("advice"))


def drop_high_missing_columns(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Drop columns whose null % is strictly above ``threshold``."""
    pct = {r["column"]: r["pct_null"] for r in null_counts(df).collect()}
    return df.drop(*[c for c, p in pct.items() if p > threshold])


def fit_imputer(df: DataFrame, strategy: str = "median", cols: list[str] | None = None,
                exclude: list[str] | tuple = (), exact: bool = True) -> dict:
    """D1 fit: fill value per column that has nulls.  Numeric columns use
    ``strategy`` (median/mean/mode); non-numeric columns always the mode."""
    cols = [c for c in (cols or df.columns) if c not in exclude]
    nulls = column_stats(df, cols, ["n_null"])
    having = [c for c in cols if nulls[c]["n_null"] > 0]
    num = set(numeric_columns(df))
    numeric = [c for c in having if c in num]
    other = [c for c in having if c not in num]
    fills = {}
    if strategy == "median":
        q = quantile_dict(df, numeric, [0.5], "exact" if exact else "approx")
        fills.update({c: q.get((c, 0.5)) for c in numeric})
    elif strategy == "mean":
        st = column_stats(df, numeric, ["mean"])
        fills.update({c: st[c]["mean"] for c in numeric})
    elif strategy == "mode":
        fills.update(modes(df, numeric))
    elif strategy != "drop":
        raise ValueError(strategy)
    if strategy != "drop":
        fills.update(modes(df, other))
    return {"strategy": strategy, "fills": fills, "columns": having}


def apply_imputer(df: DataFrame, params: dict) -> DataFrame:
    """D1 transform: coalesce with the fitted value, keeping the declared type
    (an int column filled with a median keeps int; as Spark's Imputer does
    with a cast)."""
    if params["strategy"] == "drop":
        return df.dropna(subset=params["columns"]) if params["columns"] else df
    fills = params["fills"]
    types = dict(df.dtypes)
    return df.select(*[
        F.coalesce(F.col(c), F.lit(fills[c]).cast(types[c])).alias(c) if fills.get(c) is not None else F.col(c)
        for c in df.columns])


def impute(df: DataFrame, strategy: str = "median", cols=None, exclude=(), exact: bool = True) -> DataFrame:
    return apply_imputer(df, fit_imputer(df, strategy, cols, exclude, exact))


def prepare_impute(df: DataFrame, exclude=()) -> tuple[DataFrame, dict]:
    """Numeric median, string mode; returns the frame and the params
    (with the remaining-null check as a lazy metric frame)."""
    params = fit_imputer(df, "median", exclude=exclude)
    out = apply_imputer(df, params)
    return out, params
