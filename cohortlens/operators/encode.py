"""Encoding, scaling, transformation and selection.

Fits are aggregates whose output is bounded by the number of columns (or
levels, each a column of the result); transforms are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import stack_long
from ..functions.stats import column_stats


def fit_levels(df: DataFrame, cols: list[str]) -> dict:
    """Sorted distinct non-null levels per column; each becomes a column of ``one_hot``, so they reach the driver as its schema does."""
    found: dict = {c: [] for c in cols}
    for r in stack_long(df, cols, "string").where(F.col("value").isNotNull()).distinct().collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def one_hot(df: DataFrame, levels: dict, drop_first: bool = True, prefix_sep: str = "_") -> DataFrame:
    """E13 (drop_first) / E14 (keep all; unknown levels -> all zeros).
    NULL -> all zeros.  The source column is dropped."""
    out = [F.col(c) for c in df.columns if c not in levels]
    for c, lv in levels.items():
        use = lv[1:] if drop_first else lv
        out += [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}{prefix_sep}{v}")
                for v in use]
    return df.select(*out)


def correlated_to_drop(df: DataFrame, cols: list[str], threshold: float = 0.7) -> DataFrame:
    """A later column is dropped if ANY earlier column (dropped or not)
    has |corr| > threshold — one pass over the upper triangle, as the
    reference; returns (column, because_of) with the first such earlier column."""
    from .profile import corr_pairs
    pairs = corr_pairs(df, cols).where(F.abs("corr") > threshold)
    idx = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return (pairs.groupBy(F.col("col_b").alias("column"))
            .agg(F.min_by("col_a", idx[F.col("col_a")]).alias("because_of")))


def fit_standard(df: DataFrame, cols: list[str]) -> dict:
    """E16 fit: mean and population sd (sklearn StandardScaler; Spark ML's
    StandardScaler uses the sample sd)."""
    st = column_stats(df, cols, ["mean", "std_pop"])
    return {c: (st[c]["mean"], st[c]["std_pop"]) for c in cols}


def apply_standard(df: DataFrame, params: dict) -> DataFrame:
    return df.select(*[
        (F.try_divide(F.col(c) - F.lit(params[c][0]), F.lit(params[c][1] if params[c][1] else 1.0))).alias(c)
        if c in params else F.col(c) for c in df.columns])


def fit_minmax(df: DataFrame, cols: list[str]) -> dict:
    st = column_stats(df, cols, ["min", "max"])
    return {c: (st[c]["min"], st[c]["max"]) for c in cols}


def apply_minmax(df: DataFrame, params: dict, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(x - min)/(max - min)·(hi - lo) + lo; constant column -> lo."""
    out = []
    for c in df.columns:
        if c in params:
            mn, mx = params[c]
            rng = (mx - mn) if (mx is not None and mn is not None and mx != mn) else None
            e = ((F.col(c) - F.lit(mn)) / F.lit(rng) * (hi - lo) + lo) if rng else F.lit(float(lo))
            out.append(F.when(F.col(c).isNull(), F.lit(None)).otherwise(e).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def yeo_johnson_expr(x, lam):
    """Yeo-Johnson transform of column ``x`` for a lambda column/literal."""
    lam = F.lit(lam) if not hasattr(lam, "alias") else lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_grid(lo: float = -2.0, hi: float = 2.0, step: float = 0.05) -> list[float]:
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(n + 1)]


def fit_yeo_johnson(df: DataFrame, cols: list[str], grid: list[float] | None = None) -> DataFrame:
    """E18 fit: the lambda on the grid maximising the YJ log-likelihood
    -n/2·log(var_pop(y)) + (λ-1)·Σ sign(x)·log1p(|x|).

    Pass 1 ranks every (column, λ) on distinct values with counts (grid rows
    are generated inside the map stage and combined before any shuffle);
    pass 2 recomputes the log-likelihood of the chosen λ exactly over the
    rows.  Returns (column, lambda, llf); ties -> smaller lambda."""
    from pyspark.sql import Window
    grid = grid or yeo_johnson_grid()
    spark = df.sparkSession
    g = spark.createDataFrame([(float(v),) for v in grid], "lambda double")
    long = stack_long(df, cols).where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    x = F.col("value")
    y = yeo_johnson_expr(x, F.col("lambda"))
    t = vc.crossJoin(F.broadcast(g)).select("column", "lambda", "w", y.alias("y"),
                                            (F.signum(x) * F.log1p(F.abs(x))).alias("sl"))
    a = t.groupBy("column", "lambda").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("sy"),
                                          F.sum(F.col("w") * F.col("y") ** 2).alias("syy"),
                                          F.sum(F.col("w") * F.col("sl")).alias("s"))
    v = F.col("syy") / F.col("n") - (F.col("sy") / F.col("n")) ** 2
    llf = -F.col("n") / 2.0 * F.log(v) + (F.col("lambda") - 1) * F.col("s")
    w = Window.partitionBy("column").orderBy(F.desc("llf"), "lambda")   # ≤ grid rows per column
    best = {r["column"]: r["lambda"] for r in
            a.select("column", "lambda", llf.alias("llf")).withColumn("_r", F.row_number().over(w))
            .where("_r = 1").collect()}                                  # one row per column
    lam = F.create_map(*[v_ for c, l_ in best.items() for v_ in (F.lit(c), F.lit(float(l_)))])
    ex = long.withColumn("lambda", lam[F.col("column")])
    e = ex.groupBy("column", "lambda").agg(F.count(F.lit(1)).alias("n"), F.var_pop(yeo_johnson_expr(x, F.col("lambda")))
                                           .alias("v"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"))
    return e.select("column", "lambda",
                    (-F.col("n") / 2.0 * F.log(F.col("v")) + (F.col("lambda") - 1) * F.col("s")).alias("llf"))


def _yj(x, lam: float):
    """The transform at one literal lambda."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _power_sums(data: DataFrame, places: dict, centres: dict) -> dict:
    """(column, lambda) -> population variance of the transform, for the places of all columns in one Arrow pass.  Logarithms are taken once a value;
    a task leaves one row a place: sums about the transform of the column's mean."""
    import numpy as np
    import pyarrow as pa
    jobs = [(c, lam) for c, lams in places.items() for lam in lams]
    cols = list(places)

    def transform(up, down, lam):
        return (up if abs(lam) < 1e-12 else np.expm1(lam * up) / lam, -down if abs(lam - 2) < 1e-12 else -np.expm1((2 - lam) * down) / (2 - lam))

    def halves(x):
        size = np.log1p(np.abs(x))
        return size[~(x < 0)], size[x < 0]

    def run(batches):
        with np.errstate(all="ignore"):
            about = {(c, lam): float(np.concatenate(transform(*halves(np.array([centres[c]])), lam))[0]) for c, lam in jobs}
            about = {k: v if np.isfinite(v) else 0.0 for k, v in about.items()}
            n, s, q = (np.zeros(len(jobs)) for _ in range(3))
            for batch in batches:
                parts = {c: halves(batch.column(k).drop_null().to_numpy(zero_copy_only=False)) for k, c in enumerate(cols)}
                for j, (c, lam) in enumerate(jobs):
                    for y in transform(*parts[c], lam):
                        d = y - about[c, lam]
                        n[j] += len(d)
                        s[j] += d.sum()
                        q[j] += np.dot(d, d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(jobs), dtype=np.int32)), pa.array(n), pa.array(s), pa.array(q)], ["j", "n", "s", "q"])

    rows = data.select(*cols).mapInArrow(run, "j int, n double, s double, q double").groupBy("j").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()  # a row a place
    return {jobs[r["j"]]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in rows if r["n"]}


def search_yeo_johnson(df: DataFrame, cols: list[str], low: float = -2.0, high: float = 2.0, points: int = 8, width: float = 1e-7) -> dict:
    """E18 fit without a grid's error: column -> lambda.  Every column has a bracket; a round evaluates the log-likelihood at ``points`` inner places of all
    brackets in one pass and keeps the neighbours of the best, which are not evaluated again.  Brackets shrink by 2 / (points + 1) a round; nothing but
    sums leaves the tasks.  Constant and empty columns keep lambda 1."""
    from ..session import written
    data = written(df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)]))
    first = data.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("v", F.var_pop), ("m", F.avg))],
                     *[F.sum(F.signum(c) * F.log1p(F.abs(c))).alias(f"s_{c}") for c in cols]).first()
    found = {c: 1.0 for c in cols}
    brackets = {c: (low, high) for c in cols if first[f"n_{c}"] and first[f"v_{c}"]}
    centres = {c: first[f"m_{c}"] for c in brackets}
    known: dict = {}
    while brackets:
        places = {c: [a + (b - a) * i / (points + 1) if i <= points else b for i in range(points + 2)] for c, (a, b) in brackets.items()}
        known |= _power_sums(data, {c: [lam for lam in lams if (c, lam) not in known] for c, lams in places.items()}, centres)
        after = {}
        for c, lams in places.items():
            n, s = first[f"n_{c}"], first[f"s_{c}"]
            llf = [-n / 2.0 * math.log(v) + (lam - 1) * s if (v := known[c, lam]) and v > 0 and math.isfinite(v) else -math.inf for lam in lams]
            best = max(range(len(lams)), key=lambda i: llf[i])
            found[c] = lams[best]
            edge = lams[max(0, best - 1)], lams[min(len(lams) - 1, best + 1)]
            if edge[1] - edge[0] > width:
                after[c] = edge
        brackets = after
    return found


def fit_power(df: DataFrame, cols: list[str]) -> dict:
    """Column -> (lambda, mean, population sd) of the transformed column."""
    lams = search_yeo_johnson(df, cols)
    stats = fit_standard(df.select(*[_yj(F.col(c).cast("double"), lams[c]).alias(c) for c in cols]), cols)
    return {c: (lams[c], *stats[c]) for c in cols}


def apply_power(df: DataFrame, params: dict) -> DataFrame:
    """E18 transform: Yeo-Johnson, then mean 0 and sd 1; nulls stay null."""
    return df.select(*[((_yj(F.col(c).cast("double"), params[c][0]) - F.lit(params[c][1])) / F.lit(params[c][2] or 1.0)).alias(c) if c in params else F.col(c)
                       for c in df.columns])


def level_dictionary(df: DataFrame, cols: list[str], drop_first: bool = False) -> DataFrame:
    """E13/E14 fit for columns of any number of levels: (column, level, index).  Levels are numbered per column in order by a distributed prefix sum, each column
    after those before it; only one count a column reaches the driver."""
    from ..functions.ordering import global_row_number
    from ..session import written
    each = stack_long(df, cols, "string").where(F.col("value").isNotNull()).distinct()
    ranked = written(global_row_number(each, ["value"], ["column"], name="place"), "levels")
    sizes = {r["column"]: r["n"] for r in ranked.groupBy("column").agg(F.max("place").alias("n")).collect()}
    skip = 1 if drop_first else 0
    base, at = [], 0
    for c in cols:
        base += [F.lit(c), F.lit(at - 1 - skip).cast("bigint")]
        at += max(0, sizes.get(c, 0) - skip)
    return ranked.where(F.col("place") > skip).select("column", F.col("value").alias("level"), (F.create_map(*base)[F.col("column")] + F.col("place")).alias("index"))


def sparse_one_hot(df: DataFrame, cols: list[str], levels: DataFrame, out: str = "indices") -> DataFrame:
    """E13/E14 transform: the columns give way to the ascending indices of the row's levels (a sparse 0/1 vector).  Null, unknown and dropped levels have
    no index.  One join a column; a frequent level is split by the adaptive join, a short dictionary is broadcast by it."""
    rest = [c for c in df.columns if c not in cols]
    for i, c in enumerate(cols):
        own = levels.where(F.col("column") == c).select(F.col("level").alias(f"__l{i}"), F.col("index").alias(f"__i{i}"))
        df = df.join(own, F.col(c).cast("string") == F.col(f"__l{i}"), "left")
    return df.select(*rest, F.array_compact(F.array(*[F.col(f"__i{i}") for i in range(len(cols))])).alias(out))


def polynomial2(df: DataFrame, cols: list[str]) -> DataFrame:
    """Degree-2 expansion without bias: x_i, x_i·x_j (i ≤ j)."""
    out = [F.col(c) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out.append((F.col(a) * F.col(b)).alias(f"{a}*{b}" if a != b else f"{a}^2"))
    return df.select(*out)


def anova_f(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature from group sums (n, Σx, Σx²);
    (column, f_stat) — sklearn f_classif."""
    long = stack_long(df, cols, keep=[label]).where(F.col("value").isNotNull())
    g = long.groupBy("column", label).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"),
                                          F.sum(F.col("value") ** 2).alias("ss"))
    t = g.groupBy("column").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("S"),
                                F.sum("ss").alias("SS"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between_raw"))
    ssb = F.col("between_raw") - F.col("S") ** 2 / F.col("N")
    sst = F.col("SS") - F.col("S") ** 2 / F.col("N")
    ssw = sst - ssb
    f = F.try_divide(ssb / (F.col("k") - 1), ssw / (F.col("N") - F.col("k")))
    return t.select("column", f.alias("f_stat"))


def select_k_best(df: DataFrame, cols: list[str], label: str, k: int = 4) -> DataFrame:
    """Top-k features by ANOVA F (ties by name)."""
    from pyspark.sql import Window
    f = anova_f(df, cols, label)
    w = Window.orderBy(F.desc("f_stat"), "column")      # ≤ #features rows
    return f.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


# Target-name candidates.
TARGET_NAMES = ["appendicitis", "diagnosis", "target", "label", "appendicite"]


def guess_target(df: DataFrame) -> str | None:
    """Name list first, else the last binary column (A5)."""
    for c in TARGET_NAMES:
        if c in df.columns:
            return c
    named = [c for c in df.columns if "appendicitis" in c.lower() or "diagnosis" in c.lower()]
    if named:
        return named[0]
    row = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).collect()[0]
    binary = [c for c in df.columns if row[c] == 2]
    return binary[-1] if binary else None
