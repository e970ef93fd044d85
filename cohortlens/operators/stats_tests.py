"""Two-group statistical tests (H1-H3) from distributed group sums and
mid-ranks; p-values from closed forms (normal via erf series in SQL is not
available in Spark, so the normal p is computed with ``erfc``-free rational
approximation in a Spark expression)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import mid_ranks, stack_long


def _phi_upper(z: Column) -> Column:
    """P(Z > z) for z ≥ 0, Abramowitz-Stegun 26.2.17 (|error| < 7.5e-8)."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2.0) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def mann_whitney(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """H1: U of the positive group per feature, tie-corrected normal
    approximation (two-sided, no continuity correction), significance at .05."""
    long = stack_long(df, cols, keep=[label]).where(F.col("value").isNotNull())
    long = long.withColumn("_pos", (F.col(label) == 1).cast("long"))
    r = mid_ranks(long, "value", ["column"], ["_pos"])
    g = r.groupBy("column").agg(F.sum(F.col("mid_rank") * F.col("_pos")).alias("R1"), F.sum("_pos").alias("n1"),
                                F.sum("cnt").alias("n"), F.sum(F.col("cnt") ** 3 - F.col("cnt")).alias("tie"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u1 = F.col("R1") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.abs(u1 - mu) / sigma
    p = F.least(F.lit(1.0), 2 * _phi_upper(z))
    return g.select("column", u1.alias("u_stat"), ((u1 - mu) / sigma).alias("z"), p.alias("p_value"),
                    (p < 0.05).alias("significant"))


def welch_t(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """H2: Welch t and Welch-Satterthwaite df per feature (positive minus
    negative group)."""
    long = stack_long(df, cols, keep=[label]).where(F.col("value").isNotNull())
    g = long.groupBy("column").agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("m1"),
        F.var_samp(F.when(F.col(label) == 1, F.col("value"))).alias("v1"),
        F.count_if(F.col(label) == 0).alias("n0"), F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("m0"),
        F.var_samp(F.when(F.col(label) == 0, F.col("value"))).alias("v0"))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(a + b)
    dof = (a + b) ** 2 / (a ** 2 / (F.col("n1") - 1) + b ** 2 / (F.col("n0") - 1))
    return g.select("column", t.alias("t_stat"), dof.alias("df"))


def _betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), vectorised (continued fraction,
    modified Lentz), for the Student-t tail."""
    import numpy as np
    from math import lgamma
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    lbeta = np.vectorize(lambda p, q: lgamma(p) + lgamma(q) - lgamma(p + q))(a, b)
    front = np.exp(np.log(np.clip(x, 1e-300, 1)) * a + np.log(np.clip(1 - x, 1e-300, 1)) * b - lbeta)

    def cf(a, b, x):
        tiny = 1e-300
        c = np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = np.where(np.abs(d) < tiny, tiny, d)
        d = 1 / d
        h = d.copy()
        for m in range(1, 300):
            m2 = 2 * m
            aa = m * (b - m) * x / ((a + m2 - 1) * (a + m2))
            d = 1 + aa * d
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + aa / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            h = h * d * c
            aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))
            d = 1 + aa * d
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + aa / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            h = h * d * c
        return h
    use_direct = x < (a + 1) / (a + b + 2)
    direct = front * cf(a, b, x) / a
    flipped = 1 - front * cf(b, a, 1 - x) / b
    out = np.where(use_direct, direct, flipped)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided_p(t, dof):
    """Two-sided Student-t p-value: I_{df/(df+t²)}(df/2, 1/2)."""
    import numpy as np
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return _betainc(dof / 2.0, np.full_like(dof, 0.5), dof / (dof + t * t))


def welch_t_test(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """H2 with p-values: t and df from distributed group moments (k rows),
    then an Arrow pandas UDF evaluates the t tail on those k rows only."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def pval(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided_p(t.to_numpy(), d.to_numpy()))
    w = welch_t(df, cols, label)
    p = pval(F.col("t_stat"), F.col("df"))
    return w.select("*", p.alias("p_value"), (p < 0.05).alias("significant"))
