"""Univariate outlier detection and treatment.

Fit = one small statistics job (bounded output: a few numbers per column);
detect/treat = column expressions over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantile_dict, running_sum, stack_long
from ..functions.scalar import clip
from ..functions.stats import column_stats
from ..session import written

Q_PROBS = {"iqr": [0.25, 0.75], "percentile": [0.01, 0.99]}


def fit_bounds(df: DataFrame, cols: list[str], method: str = "iqr", threshold: float | None = None,
               need_center: bool = True, exact: bool = True) -> dict:
    """Per-column detection bounds plus the statistics every treatment needs
    (mean, sample sd, median, q.05/q.95) — one moments job and one quantile
    job for all columns."""
    probs = sorted(set(Q_PROBS.get(method, []) + ([0.5, 0.05, 0.95] if need_center else [])))
    q = quantile_dict(df, cols, probs, "exact" if exact else "approx") if probs else {}
    st = column_stats(df, cols, ["mean", "std_samp", "std_pop"])
    out = {}
    for c in cols:
        mean, sd = st[c]["mean"], st[c]["std_samp"]
        b = {"mean": mean, "sd": sd, "sd_pop": st[c]["std_pop"], "median": q.get((c, 0.5)),
             "q05": q.get((c, 0.05)), "q95": q.get((c, 0.95))}
        if method == "iqr":
            k = 1.5 if threshold is None else threshold
            q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
            if q1 is None:
                continue
            b.update(lo=q1 - k * (q3 - q1), hi=q3 + k * (q3 - q1))
        elif method == "zscore":
            k = 3.0 if threshold is None else threshold
            if sd is None or sd == 0:      # sd = 0 -> column skipped, no stats row
                continue
            b.update(lo=mean - k * sd, hi=mean + k * sd, z=k)
        elif method == "percentile":
            b.update(lo=q[(c, 0.01)], hi=q[(c, 0.99)])
        else:
            raise ValueError(method)
        out[c] = b
    return out


def flag_expr(c: str, b: dict, method: str) -> Column:
    x = F.col(c)
    if method == "zscore":   # |x - mean| / sd > k, the reference's form
        return F.coalesce(F.abs((x - F.lit(b["mean"])) / F.lit(b["sd"])) > F.lit(b["z"]), F.lit(False))
    return F.coalesce((x < F.lit(b["lo"])) | (x > F.lit(b["hi"])), F.lit(False))


def treat_expr(c: str, b: dict, method: str, treatment: str) -> Column:
    x, flag = F.col(c), flag_expr(c, b, method)
    if treatment in ("none", "remove"):
        return x
    if treatment == "cap":
        if method in ("iqr", "percentile"):
            return clip(c, b["lo"], b["hi"])
        return clip(c, b["mean"] - 3 * b["sd"], b["mean"] + 3 * b["sd"])
    if treatment == "mean":
        return F.when(flag, F.lit(b["mean"])).otherwise(x)
    if treatment == "median":
        return F.when(flag, F.lit(b["median"])).otherwise(x)
    if treatment == "winsorize":
        return clip(c, b["q05"], b["q95"])
    raise ValueError(treatment)


def handle_outliers(df: DataFrame, cols: list[str], method: str = "iqr", treatment: str = "cap",
                    column_params: dict | None = None, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Detect per column by ``method`` and apply ``treatment``;
    ``column_params`` = {col: {"method":…, "treatment":…}} overrides (D7).
    Returns (treated frame, lazy statistics frame (D8))."""
    column_params = column_params or {}
    plan = {c: (column_params.get(c, {}).get("method", method),
                column_params.get(c, {}).get("treatment", treatment)) for c in cols}
    bounds = {}
    for m in sorted({m for m, _ in plan.values()}):
        cs = [c for c in cols if plan[c][0] == m]
        # centre statistics (median, q.05/q.95) only when a treatment uses them
        center = any(plan[c][1] in ("median", "winsorize") for c in cs)
        for c, b in fit_bounds(df, cs, m, need_center=center, exact=exact).items():
            bounds[c] = b
    active = [c for c in cols if c in bounds]
    flags = {c: flag_expr(c, bounds[c], plan[c][0]) for c in active}
    removers = [flags[c] for c in active if plan[c][1] == "remove"]
    drop = F.lit(False)
    for r in removers:
        drop = drop | r
    base = df.where(~drop) if removers else df
    treated = base.select(*[treat_expr(c, bounds[c], *plan[c]).alias(c) if c in bounds else F.col(c)
                            for c in df.columns])
    stats = outlier_stats(df, flags, plan, drop)
    return treated, stats


def outlier_stats(df: DataFrame, flags: dict, plan: dict, drop: Column) -> DataFrame:
    """One agg: count per column + rows removed, as a long table."""
    cols = list(flags)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, method string, treatment string, n_outliers bigint, pct_outliers double, "
                "rows_removed bigint, total_outlier_columns int")
    row = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(drop).alias("_removed"),
                 *[F.count_if(flags[c]).alias(c) for c in cols])
    long = stack_long(row, cols, "bigint", keep=["_rows", "_removed"], value_col="n_outliers")
    meth = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(plan[c][0]))])
    trt = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(plan[c][1]))])
    n_cols = F.lit(0)
    for c in cols:
        n_cols = n_cols + (F.col(c) > 0).cast("int")
    tot = row.select(n_cols.alias("total_outlier_columns"))
    return long.crossJoin(tot).select(
        "column", meth[F.col("column")].alias("method"), trt[F.col("column")].alias("treatment"),
        "n_outliers", (F.col("n_outliers") * 100.0 / F.col("_rows")).alias("pct_outliers"),
        F.col("_removed").alias("rows_removed"), "total_outlier_columns")


def prep_zcap(df: DataFrame, cols: list[str]) -> DataFrame:
    """Detect with population z > 3, cap at mean ± 3·sample sd only when
    something was detected.  Since sd_samp ≥ sd_pop, a value beyond
    mean ± 3·sd_samp is always also detected, so the unconditional clip is
    exactly the conditional one — one statistics job, no second pass."""
    st = column_stats(df, cols, ["mean", "std_samp"])
    out = []
    for c in df.columns:
        if c in cols and st[c]["std_samp"] not in (None, 0):
            m, s = st[c]["mean"], st[c]["std_samp"]
            out.append(clip(c, m - 3 * s, m + 3 * s).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def zscore_report(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Population-z outliers per column with advice."""
    st = column_stats(df, cols, ["mean", "std_pop"])
    use = [c for c in cols if st[c]["std_pop"] not in (None, 0)]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.abs((F.col(c) - F.lit(st[c]["mean"])) / F.lit(st[c]["std_pop"])) > threshold).alias(c)
        for c in use])
    long = stack_long(row, use, "bigint", keep=["_rows"], value_col="n_outliers")
    pct = F.col("n_outliers") * 100.0 / F.col("_rows")
    adv = F.when(pct > 5, "Investigate specific domain relationship with target").otherwise(
        "Consider capping/flooring at 3 std devs")
    return long.where(F.col("n_outliers") > 0).select("column", "n_outliers", pct.alias("pct_outliers"),
                                                      adv.alias("advice"))


# ---- D12: 1-D DBSCAN noise ---------------------------------------------------

def _range_counts(vals: DataFrame, eps: float, weight: str) -> DataFrame:
    """For each distinct (column, value): Σ weight over values within
    [value-eps, value+eps], via one running sum over value + query events
    (no pairs are ever formed)."""
    data = vals.select("column", F.col("value").alias("key"), F.lit(1).alias("kind"),
                       F.col(weight).cast("double").alias("w"), F.lit(None).cast("double").alias("qv"))
    lower = vals.select("column", (F.col("value") - eps).alias("key"), F.lit(0).alias("kind"),
                        F.lit(0.0).alias("w"), F.col("value").alias("qv"))
    upper = vals.select("column", (F.col("value") + eps).alias("key"), F.lit(2).alias("kind"),
                        F.lit(0.0).alias("w"), F.col("value").alias("qv"))
    ev = data.unionByName(lower).unionByName(upper)
    rs = running_sum(ev, ["key", "kind"], ["w"], ["column"])
    q = rs.where(F.col("kind") != 1).groupBy("column", "qv").agg(
        (F.max(F.when(F.col("kind") == 2, F.col("cum_w"))) - F.max(F.when(F.col("kind") == 0, F.col("cum_w"))))
        .alias("in_range"))
    return q.withColumnRenamed("qv", "value")


def dbscan_noise_values(df: DataFrame, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Per column, population-standardise, then exact 1-D DBSCAN:
    core = ≥ min_samples values within ±eps (itself included); noise = not
    core and no core value within ±eps.  Returns distinct
    (column, raw, value(z), cnt, core, noise)."""
    st = column_stats(df, cols, ["mean", "std_pop"])
    use = [c for c in cols if st[c]["std_pop"] not in (None, 0)]
    zexpr = {c: (F.col(c) - F.lit(st[c]["mean"])) / F.lit(st[c]["std_pop"]) for c in use}
    long = stack_long(df.select(*[zexpr[c].alias(c) for c in use]), use).where(F.col("value").isNotNull())
    vals = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    n = _range_counts(vals, eps, "cnt")
    v2 = vals.join(n, ["column", "value"]).withColumn("core", F.col("in_range") >= min_samples).drop("in_range")
    # the core pass reads the first pass's result: materialise it in the
    # shared checkpoint folder instead of recomputing its lineage
    from ..session import cut_lineage
    v2 = cut_lineage(v2)
    c2 = _range_counts(v2.withColumn("is_core", F.col("core").cast("int")), eps, "is_core")
    out = v2.join(c2, ["column", "value"])
    return out.select("column", "value", "cnt", "core",
                      ((~F.col("core")) & (F.col("in_range") == 0)).alias("noise"))


def dbscan_noise_counts(df: DataFrame, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(column, n_noise) — rows whose value is DBSCAN noise."""
    v = dbscan_noise_values(df, cols, eps, min_samples)
    return v.groupBy("column").agg(F.sum(F.when(F.col("noise"), F.col("cnt")).otherwise(0)).cast("bigint")
                                   .alias("n_noise"))


def dbscan_noise_ranges(df: DataFrame, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> dict[str, list[tuple[float, float]]]:
    """{column: [(lowest, highest)]}: the runs of noise values that no other value lies between, on the population-standardised scale.

    Two runs are parted by a core value and all within eps of it.  With n rows the standardised values' squares sum to n, and each such core has
    ``min_samples`` rows about it, so that there are at most about 2 * (3 n / min_samples)^(1/3) runs a column: some 17,000 for 10^12 rows."""
    values = written(dbscan_noise_values(df, cols, eps, min_samples), "dbscan-values")
    clean = running_sum(values.withColumn("clean", (~F.col("noise")).cast("bigint")), ["value"], ["clean"], ["column"])
    runs = clean.where("noise").groupBy("column", "cum_clean").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    out: dict = {}
    for r in sorted(runs, key=lambda r: (r["column"], r["low"])):
        out.setdefault(r["column"], []).append((r["low"], r["high"]))
    return out


def in_ranges(x: Column, ranges: list[tuple[float, float]]) -> Column:
    """True where x lies in one of the ranges; false for null."""
    if not ranges:
        return F.lit(False)
    lows, highs = (F.lit([r[k] for r in ranges]) for k in (0, 1))
    return F.coalesce(F.exists(F.arrays_zip(lows.alias("low"), highs.alias("high")), lambda r: (x >= r["low"]) & (x <= r["high"])), F.lit(False))


# ---- D16 / D17 --------------------------------------------------------------

def treat_flagged_rows(df: DataFrame, flag_col: str, cols: list[str], treatment: str = "median",
                       exact: bool = True) -> DataFrame:
    """Rows flagged by an ensemble: remove, or replace every numeric
    value of the row by the column mean/median (statistics from the whole
    column), or cap at mean ± 3 sd."""
    if treatment == "remove":
        return df.where(~F.col(flag_col))
    b = fit_bounds(df, cols, "zscore", exact=exact) if treatment == "cap" else None
    if treatment == "median":
        q = quantile_dict(df, cols, [0.5], "exact" if exact else "approx")
        rep = {c: F.lit(q[(c, 0.5)]) for c in cols}
    elif treatment == "mean":
        st = column_stats(df, cols, ["mean"])
        rep = {c: F.lit(st[c]["mean"]) for c in cols}
    elif treatment == "cap":
        rep = {c: clip(c, b[c]["lo"], b[c]["hi"]) for c in cols if c in b}
    else:
        raise ValueError(treatment)
    types = dict(df.dtypes)
    return df.select(*[F.when(F.col(flag_col), rep[c].cast(types[c])).otherwise(F.col(c)).alias(c)
                       if c in rep else F.col(c) for c in df.columns])


def fit_reference_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """D17 fit: the stored (column, mean, sd) table (sample sd)."""
    row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols])
    parts = ", ".join(f"'{c}', `{c}__m`, `{c}__s`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {parts}) AS (column, mean, sd)")


def flag_against_stats(df: DataFrame, stats: dict, threshold: float = 3.0) -> DataFrame:
    """D17 transform: |z| against stored stats; adds z_flag_count and
    z_flagged (comma list in column order).  ``stats`` = {col: (mean, sd)}
    collected from the (tiny) stats table; works on batch and stream."""
    cols = [c for c in stats if stats[c][1] not in (None, 0)]
    hits = [F.when(F.abs((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])) > threshold, F.lit(c)) for c in cols]
    cnt = sum((F.coalesce(F.abs((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])) > threshold, F.lit(False))
               .cast("int") for c in cols), F.lit(0))
    return df.select("*", cnt.alias("z_flag_count"), F.concat_ws(",", *hits).alias("z_flagged"))


def handle_outliers_model(df: DataFrame, cols: list[str], method: str, id_col: str, treatment: str = "cap",
                          contamination: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """D3-D8 for the model-based per-column methods: ``dbscan`` (1-D DBSCAN
    noise on the population-standardised column, eps .5, min 5) and
    ``isolation_forest`` (one forest per column, contamination .05).  Flags
    come on the row: for DBSCAN by the few ranges of noise values, without a join; treatments as in :func:`treat_expr` with
    mean ± 3·sd capping.  Returns (treated frame, statistics frame)."""
    if treatment not in ("none", "remove", "cap", "mean", "median"):
        raise ValueError(f"model-based methods have no treatment {treatment!r}")
    st = column_stats(df, cols, ["mean", "std_samp", "std_pop"])
    flagged = df
    if method == "dbscan":
        ranges = dbscan_noise_ranges(df, cols)
        z = {c: (F.col(c) - F.lit(st[c]["mean"])) / F.lit(st[c]["std_pop"]) for c in cols if st[c]["std_pop"] not in (None, 0)}
        flagged = df.select("*", *[in_ranges(z[c], ranges.get(c, [])).alias(f"{c}__outlier") for c in z])
    elif method == "isolation_forest":
        from .multivariate import column_forests
        flagged = column_forests(df, cols, id_col, contamination=contamination)
    else:
        raise ValueError(method)
    flags = {c: F.coalesce(F.col(f"{c}__outlier"), F.lit(False)) for c in cols if f"{c}__outlier" in flagged.columns}
    b = {c: {"mean": st[c]["mean"], "sd": st[c]["std_samp"]} for c in flags}
    med = quantile_dict(df, list(flags), [0.5]) if treatment == "median" else {}

    def treat(c):
        x = F.col(c)
        if treatment == "cap":
            return clip(c, b[c]["mean"] - 3 * b[c]["sd"], b[c]["mean"] + 3 * b[c]["sd"])
        if treatment == "mean":
            return F.when(flags[c], F.lit(b[c]["mean"])).otherwise(x)
        if treatment == "median":
            return F.when(flags[c], F.lit(med[(c, 0.5)])).otherwise(x)
        return x
    drop = F.lit(False)
    if treatment == "remove":
        for c in flags:
            drop = drop | flags[c]
    base = flagged.where(~drop) if treatment == "remove" else flagged
    treated = base.select(*[treat(c).alias(c) if c in flags else F.col(c) for c in df.columns])
    stats = outlier_stats(flagged, flags, {c: (method, treatment) for c in flags}, drop)
    return treated, stats


def neighbour_counts(df: DataFrame, cols: list[str], eps: float = 0.5) -> DataFrame:
    """For every row, the number of rows within ±eps of its
    population-standardised value (itself included), per column — one
    running sum over value and query events, no pairs.  Returns
    (column, value, cnt, in_range) per distinct value."""
    st = column_stats(df, cols, ["mean", "std_pop"])
    use = [c for c in cols if st[c]["std_pop"] not in (None, 0)]
    zexpr = {c: (F.col(c) - F.lit(st[c]["mean"])) / F.lit(st[c]["std_pop"]) for c in use}
    long = stack_long(df.select(*[zexpr[c].alias(c) for c in use]), use).where(F.col("value").isNotNull())
    vals = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return vals.join(_range_counts(vals, eps, "cnt"), ["column", "value"])
