"""Profiling aggregates (A1-A32 that are not model metrics)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crosstab(df: DataFrame, row: str, col: str, values: list, normalize: bool = True) -> DataFrame:
    """Counts of ``row`` × ``col`` (known ``values``: no extra distinct
    job), total and row-% of the last value."""
    g = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    cnt = [F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(f"n_{v}") for v in values]
    g = g.select(row, *cnt)
    tot = sum((F.col(f"n_{v}") for v in values[1:]), F.col(f"n_{values[0]}"))
    g = g.withColumn("n", tot)
    if normalize:
        g = g.withColumn(f"pct_{values[-1]}", F.col(f"n_{values[-1]}") * 100.0 / F.col("n"))
    return g


from ..functions.ordering import quantiles, stack_long  # noqa: E402
from ..functions.stats import column_stats  # noqa: E402


def shape(df: DataFrame) -> DataFrame:
    """A1: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def describe(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """A2: count mean std(sample) min q25 q50 q75 max per column, long by
    column.  Moments in one agg; quantiles by distributed rank selection
    (``df.summary()`` is approximate)."""
    row = df.agg(*[e for c in cols for e in (
        F.count(c).cast("bigint").alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"), F.min(F.col(c).cast("double")).alias(f"{c}__min"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    parts = ", ".join(f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in cols)
    mom = row.selectExpr(f"stack({len(cols)}, {parts}) AS (column, count, mean, std, min, max)")
    q = quantiles(df, cols, [0.25, 0.5, 0.75], "exact" if exact else "approx")
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                   for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]])
    return mom.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A4: counts and % per class (total from a window over the ≤ #classes
    grouped rows, not over the table)."""
    from pyspark.sql import Window
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.select(label, "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def distinct_profile(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """A5: distinct non-null values, ratio to rows, binary / target-candidate
    flags.  ``approx`` -> HyperLogLog++ for wide profiling at scale."""
    if approx:
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(c).alias(c) for c in cols])
        long = stack_long(row, cols, "bigint", keep=["_rows"], value_col="n_distinct")
    else:
        # one row per (column, value), combined in the tasks; a null row per column keeps columns without values
        values = stack_long(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        long = values.groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("_rows"))
    return long.select("column", "n_distinct", (F.col("n_distinct") / F.col("_rows")).alias("distinct_ratio"),
                       (F.col("n_distinct") == 2).alias("is_binary"),
                       (F.col("n_distinct") <= 2).alias("target_candidate"))


def dtype_histogram(df: DataFrame) -> DataFrame:
    """Schema dtype counts (the schema is driver metadata)."""
    spark = df.sparkSession
    t = spark.createDataFrame([(c, d) for c, d in df.dtypes], "column string, dtype string")
    return t.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def center_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median (exact), mode (ties -> smallest) per column."""
    from ..functions.stats import modes
    st = column_stats(df, cols, ["mean"])
    med = quantiles(df, cols, [0.5])
    md = modes(df, cols)
    spark = df.sparkSession
    t = spark.createDataFrame([(c, st[c]["mean"], None if md[c] is None else float(md[c])) for c in cols],
                              "column string, mean double, mode double")
    return t.join(med.select("column", F.col("value").alias("median")), "column", "left")


def stds(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample and population std in one pass."""
    row = df.agg(*[e for c in cols for e in (F.stddev_samp(c).alias(f"{c}__s"), F.stddev_pop(c).alias(f"{c}__p"))])
    parts = ", ".join(f"'{c}', `{c}__s`, `{c}__p`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {parts}) AS (column, std_samp, std_pop)")


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: Pearson correlation of every pair i<j (pairwise complete); long (col_a, col_b, corr).

    One aggregate for a centre of each column, then one Arrow pass: the sums of all pairs of a batch are four matrix products, added up in Spark."""
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    centre = x.agg(*[F.avg(c).alias(c) for c in x.columns]).first()
    at = np.array([0.0 if centre[c] is None or not np.isfinite(centre[c]) else centre[c] for c in x.columns])
    first, second = np.triu_indices(len(cols), 1)

    def sums(batches):
        for b in batches:
            if b.num_rows:
                m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - at
                null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in b.columns])
                there, m = (~null).astype(float), np.where(null, 0.0, m)
                n, s, ss, sp = there.T @ there, m.T @ there, (m * m).T @ there, m.T @ m
                pair = [n[first, second], s[first, second], s[second, first], ss[first, second], ss[second, first], sp[first, second]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first), dtype=np.int32)), *map(pa.array, pair)], ["pair", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = x.mapInArrow(sums, "pair int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(ss, s):  # a column that is constant on the pair's rows has rounding alone
        v = F.col(ss) - F.col(s) * F.col(s) / F.col("n")
        return F.when(v <= F.col(ss) * 1e-13, F.lit(0.0)).otherwise(v)

    corr = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(spread("sxx", "sx") * spread("syy", "sy")))
    names = df.sparkSession.createDataFrame([(k, cols[i], cols[j]) for k, (i, j) in enumerate(zip(first.tolist(), second.tolist()))], "pair int, col_a string, col_b string")
    return names.join(total.where("n > 0"), "pair", "left").select("col_a", "col_b", corr.alias("corr"))


def target_correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """corr(feature, target), with the absolute value, ordered."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = stack_long(row, cols, "double", value_col="corr")
    return long.select("column", "corr", F.abs("corr").alias("abs_corr")).orderBy(F.desc("abs_corr"), "column")


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float = 0.7) -> DataFrame:
    """A12."""
    return corr_pairs(df, cols).where(F.abs("corr") > threshold)


def group_means(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """A13."""
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def binned_counts(df: DataFrame, bin_col) -> DataFrame:
    """Value counts of a binned column, normalised."""
    from pyspark.sql import Window
    g = df.select(bin_col.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def prob_histogram(df: DataFrame, p: str) -> DataFrame:
    """5 bands [0,.2) … [.8,1] (last closed)."""
    band = F.least(F.floor(F.col(p) * 5), F.lit(4)).cast("int")
    return df.where(F.col(p).isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def equal_width_hist(df: DataFrame, c: str, lo: float, hi: float, bins: int = 5) -> DataFrame:
    """Equal-width histogram (width_bucket semantics; the top edge goes
    to the last bin)."""
    b = F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, cols: list[str], label: str = "original") -> DataFrame:
    """q1 median q3, whiskers (1.5·IQR clipped to data), outlier count."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    found = q.collect()  # one row a column: kept, or the join below would select the quantiles again
    q = df.sparkSession.createDataFrame(found, q.schema)
    qd = {r["column"]: r for r in found}
    exprs = []
    for c in cols:
        q1, q3 = qd[c]["q1"], qd[c]["q3"]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = F.col(c)
        exprs += [F.min(F.when(x >= lo, x)).alias(f"{c}__wlo"), F.max(F.when(x <= hi, x)).alias(f"{c}__whi"),
                  F.count_if((x < lo) | (x > hi)).alias(f"{c}__nout")]
    row = df.agg(*exprs)
    parts = ", ".join(f"'{c}', CAST(`{c}__wlo` AS DOUBLE), CAST(`{c}__whi` AS DOUBLE), `{c}__nout`" for c in cols)
    w = row.selectExpr(f"stack({len(cols)}, {parts}) AS (column, whisker_lo, whisker_hi, n_outliers)")
    return q.join(w, "column").select(F.lit(label).alias("frame"), "column", "q1", "median", "q3",
                                      "whisker_lo", "whisker_hi", "n_outliers")


def zero_density(df: DataFrame, cols: list[str], sparse_threshold: float = 50.0) -> DataFrame:
    """% zeros (NULL counts as non-zero, as pandas) and sparse flag."""
    row = df.agg(*[(F.avg(F.coalesce((F.col(c) == 0).cast("double"), F.lit(0.0))) * 100).alias(c) for c in cols])
    long = stack_long(row, cols, "double", value_col="pct_zero")
    return long.select("column", "pct_zero", (F.col("pct_zero") > sparse_threshold).alias("sparse_candidate"))


def decimal_places(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most decimal places used by a float column."""
    row = df.agg(*[F.max(F.length(F.split_part(F.col(c).cast("string"), F.lit("."), F.lit(2)))).alias(c) for c in cols])
    return stack_long(row, cols, "int", value_col="max_decimals")


def duplicate_columns(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """Duplicate columns.  One agg of order-free fingerprints
    ``sum(hash(id, c))`` per column; equal fingerprints (same type) are
    confirmed exactly with ``count_if(not a <=> b) = 0`` in a second agg.
    Returns (column, duplicate_of) where duplicate_of is the earlier column."""
    types = dict(df.dtypes)
    fp = df.agg(*[F.sum(F.hash(F.col(id_col), F.col(c)).cast("bigint")).alias(c) for c in cols]).collect()[0]
    cands = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]
             if types[a] == types[b] and fp[a] == fp[b]]
    spark = df.sparkSession
    if not cands:
        return spark.createDataFrame([], "column string, duplicate_of string")
    row = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"{a}__{b}") for a, b in cands]).collect()[0]
    dup, seen = [], set()
    for a, b in cands:
        if row[f"{a}__{b}"] == 0 and b not in seen:
            seen.add(b)
            dup.append((b, a))
    return spark.createDataFrame(dup, "column string, duplicate_of string")


def feature_health(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min max mean std (pop), extreme (|x|>10 anywhere) and
    near-constant (std < .01) flags."""
    row = df.agg(*[e for c in cols for e in (
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])
    parts = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__mean`, `{c}__std`" for c in cols)
    t = row.selectExpr(f"stack({len(cols)}, {parts}) AS (column, min, max, mean, std)")
    return t.select("*", ((F.abs("min") > 10) | (F.abs("max") > 10)).alias("extreme"),
                    (F.col("std") < 0.01).alias("near_constant"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (2 · n_c) per class (balanced weights)."""
    from pyspark.sql import Window
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    k = F.count(F.lit(1)).over(Window.partitionBy())
    return g.select(label, "n_c", (F.sum("n_c").over(Window.partitionBy()) / (k * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach A32 weights as a weightCol (≤ #classes rows, broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)
