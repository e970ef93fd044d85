"""Global ordering without one task.

Running sums, ranks and exact quantiles over a whole table normally mean a
window with no ``partitionBy`` — every row in one task.  A running sum here is a
two-level prefix sum:

1. range-partition by (partition keys, order keys), so that a range's size is
   Spark's partition size whatever the keys hold, and write the ranges once,
2. total each range (one row per range and key) and prefix-sum these totals,
3. run the window inside each range only and add its range's offset.

Exact quantiles are a distributed selection (see ``exact_quantiles``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SEED = 42


def hash_key(id_col: str | Column, seed: int = SEED) -> Column:
    """Seeded pseudo-random order key: first 60 bits of md5(id | seed) as a
    bigint.  Identical in DuckDB as the first 15 hex digits of the same md5."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def hash_key_sql(id_sql: str, seed: int = SEED) -> str:
    """DuckDB text ordering equivalent to :func:`hash_key`."""
    return f"substr(md5(CAST({id_sql} AS VARCHAR) || '|{seed}'), 1, 15)"


def grid_sides(n: int, tries: int = 200_000) -> tuple[int, int]:
    """(a, b) near the root of n with a * b >= n as tightly as possible: the domain of a permutation of n places."""
    import numpy as np
    root = max(1, int(np.sqrt(n)))
    a = np.arange(root, root + min(tries, root + 1), dtype=np.int64)
    over = -(-n // a) * a - n
    best = int(a[over.argmin()])
    return best, -(-n // best)


def permuted_position(position, n: int, key, seed: int = SEED, rounds: int = 6):
    """A bijection of the positions 0..n-1, another one for every value of ``key``, as an expression: no sort, no exchange.

    A Feistel network over the grid a x b: in turn each coordinate moves by a hash of the other.  Places of the grid beyond n - 1 (at most
    a * b - n) walk on along their cycle until they are inside."""
    a, b = grid_sides(n)

    def step(x):
        left, right = F.floor(x / F.lit(b)).cast("bigint"), F.pmod(x, F.lit(b))
        for r in range(rounds):
            if r % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(seed * 100 + r)), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(seed * 100 + r)), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    out = step(position.cast("bigint"))
    over = a * b - n
    return F.aggregate(F.sequence(F.lit(1), F.lit(over)), out, lambda x, _: F.when(x >= n, step(x)).otherwise(x)) if over else out


def running_sum(df: DataFrame, order_cols: list[str] | str, weights: list[str] | str,
                partition_cols: list[str] | tuple = (), descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sum of ``weights`` ordered by ``order_cols`` (a total
    order within each partition), per partition.  Adds ``{prefix}{w}``."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    weights = [weights] if isinstance(weights, str) else list(weights)
    part = list(partition_cols)
    oc = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    ranged = written(df.repartitionByRange(*[F.col(p).asc() for p in part], *oc).withColumn("_range", F.spark_partition_id()))
    tot = ranged.groupBy(*part, "_range").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    # one row per range (and key in it); ranges are numbered in the order asked for
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*[F.col(p).alias(f"_p_{p}") for p in part], F.col("_range").alias("_r"),
                     *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights])
    same = F.col("_range") == F.col("_r")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    inside = Window.partitionBy(*part, "_range").orderBy(*oc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.col(c) for c in df.columns] + [
        (F.col(f"_o_{w}") + F.sum(w).over(inside)).alias(f"{prefix}{w}") for w in weights]
    return ranged.join(off, same).select(*out)


def global_row_number(df: DataFrame, order_cols: list[str], partition_cols: list[str] | tuple = (),
                      descending: bool = False, name: str = "rn") -> DataFrame:
    """``row_number()`` over a (partitioned) total order, without a
    single-task window."""
    tmp = df.withColumn("_one", F.lit(1).cast("bigint"))
    r = running_sum(tmp, order_cols, ["_one"], partition_cols, descending, prefix="_rn")
    return r.withColumnRenamed("_rn_one", name).drop("_one")


def stack_long(df: DataFrame, cols: list[str], value_type: str = "double",
               keep: list[str] | tuple = (), name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Unpivot ``cols`` into (column, value) in one pass."""
    if not cols:
        raise ValueError("no columns to stack")
    parts = ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in cols)
    keep_s = [f"`{k}`" for k in keep]
    return df.selectExpr(*keep_s, f"stack({len(cols)}, {parts}) AS ({name_col}, {value_col})")


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, cnt) of non-null values; map-side combined."""
    return (stack_long(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))


def _inside(x, lo: float, hi: float):
    """x in [lo, hi), where the last range holds +inf as well and none holds NaN."""
    return (x >= F.lit(lo)) & ((x <= F.lit(hi)) if hi == float("inf") else (x < F.lit(hi)))


def _refine_ranges(df: DataFrame, ranges: dict, buckets: int, limit: int, targets) -> dict:
    """Split target ranges holding more than ``limit`` rows again (sketch
    bounds + bucket counts restricted to each range) until every range a
    target rank falls in is small, or holds a single distinct value (one
    row after value counting).  Each round shrinks a range ~buckets×."""
    from pyspark.ml.feature import Bucketizer
    ranges = dict(ranges)
    final = set()
    while True:
        big = [(k, v) for k, v in ranges.items() if v[1] > limit and k not in final]
        if not big:
            return ranges
        fr = [i / buckets for i in range(1, buckets)]
        xs = []
        for i, ((c, lo, hi), _) in enumerate(big):
            x = F.col(c).cast("double")
            xs.append(F.when(_inside(x, lo, hi), x).alias(f"_r{i}"))
        sub = df.select(*xs)
        a = sub.agg(*[F.percentile_approx(f"_r{i}", fr, 2 * buckets).alias(f"_r{i}") for i in range(len(big))]).collect()[0]
        work = []
        for i, ((c, lo, hi), info) in enumerate(big):
            inner = sorted({float(b) for b in (a[f"_r{i}"] or []) if lo < b < hi})
            if not inner:                  # one distinct value (or none) left in the range
                final.add((c, lo, hi))
            else:
                work.append((i, (c, lo, hi), info, [lo] + inner + [hi]))
        if not work:
            return ranges
        bz = Bucketizer(splitsArray=[w[3] for w in work], inputCols=[f"_r{w[0]}" for w in work],
                        outputCols=[f"_s{w[0]}" for w in work], handleInvalid="keep")
        bkt = bz.transform(sub)
        per = (bkt.select(F.explode(F.array(*[F.struct(F.lit(w[0]).alias("r"), F.col(f"_s{w[0]}").cast("int").alias("b"))
                                              for w in work])).alias("t"))
               .select("t.*").where(F.col("b").isNotNull()).groupBy("r", "b").agg(F.count(F.lit(1)).alias("rows")))
        counts = {(r["r"], r["b"]): r["rows"] for r in per.collect()}
        for i, key, (offset, rows, positions), spl in work:
            del ranges[key]
            c = key[0]
            cum = offset
            for b in range(len(spl) - 1):
                rb = counts.get((i, b), 0)
                inside = {q for q in positions if cum <= q < cum + rb}
                if inside:
                    ranges.setdefault((c, spl[b], spl[b + 1]), [cum, rb, set()])[2].update(inside)
                cum += rb
    return ranges


WIDE = "decimal(38,18)"


def _native(df: DataFrame, c: str):
    """A column's value as a number that keeps all its digits: whole numbers, decimals, and times in microseconds; null for doubles."""
    kind = dict(df.dtypes)[c]
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.col(c).try_cast(WIDE)
    return F.lit(None).cast(WIDE)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], buckets: int = 256,
                    refine_limit: int = 4_000_000, neighbours: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default,
    Spark ``percentile``, DuckDB ``quantile_cont``) by distributed selection —
    no task ever holds a whole column.  The columns are written once, narrow, and
    read by every step:

    A. one aggregate: non-null count and ``buckets`` approximate bounds per
       column (bounded sketches);
    B. one aggregate: rows per (column, bucket) — tells exactly which bucket
       holds each target rank and how many rows precede it; buckets of over
       ``refine_limit`` rows are cut again until they are smaller or one value;
    C. only the rows of those target buckets (≈ n/buckets each) are
       value-counted and ranked inside their bucket.

    Buckets are cut by the value as a double, which keeps the order of longs, decimals and times (though not their last digits); inside a bucket
    the native value decides.  Infinities are values like others, NaN and null are none.

    Returns (column, prob, value); with ``neighbours`` also (low, high), the two values that the quantile lies between with all their
    digits (null for columns of doubles)."""
    import math
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    df = df.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if kinds[c] in ("timestamp", "timestamp_ntz", "date")
                     else F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in dict.fromkeys(cols)])
    df = written(df)
    fr = [i / buckets for i in range(1, buckets)]
    a = df.agg(*[F.count(c).alias(f"{c}__n") for c in cols],
               *[F.percentile_approx(F.col(c).cast("double"), fr, 2 * buckets).alias(f"{c}__b") for c in cols]).collect()[0]
    n = {c: a[f"{c}__n"] for c in cols}
    bounds = {c: sorted(set(a[f"{c}__b"] or [])) for c in cols}
    live = [c for c in cols if n[c]]
    # bucket i = [splits[i], splits[i+1]) with splits = -inf, bounds..., +inf
    splits = {c: [float("-inf")] + [float(b) for b in bounds[c] if math.isfinite(b)] + [float("inf")] for c in live}
    cnt = {}
    if live:
        from pyspark.ml.feature import Bucketizer
        src = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(live)])
        # rows per (column, bucket): JVM binary search per value (one
        # multi-column Bucketizer pass), map-side combined
        bz = Bucketizer(splitsArray=[splits[c] for c in live], inputCols=[f"_x{i}" for i in range(len(live))],
                        outputCols=[f"_b{i}" for i in range(len(live))], handleInvalid="keep")
        bk = bz.transform(src)
        per = (bk.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_b{i}").cast("int").alias("bk"))
                                             for i, c in enumerate(live)])).alias("t"))
               .select("t.*").where(F.col("bk").isNotNull())
               .groupBy("column", "bk").agg(F.count(F.lit(1)).alias("rows")))
        for r in per.collect():                       # ≤ #columns × buckets rows
            cnt[(r["column"], r["bk"])] = r["rows"]
    targets, ranges = [], {}          # ranges: (column, lo, hi) -> [offset, rows]
    for c in live:
        nb = len(splits[c]) - 1
        cum, starts = 0, []
        for b in range(nb):
            starts.append(cum)
            cum += cnt.get((c, b), 0)
        for p in probs:
            h = (n[c] - 1) * p
            lo, hi = int(math.floor(h)), int(math.ceil(h))
            targets.append((c, float(p), float(h), lo, hi))
            for pos in {lo, hi}:
                b = max(i for i in range(nb) if starts[i] <= pos)
                key = (c, splits[c][b], splits[c][b + 1])
                ranges.setdefault(key, [starts[b], cnt.get((c, b), 0), set()])[2].add(pos)
    if not targets:
        return spark.createDataFrame([], "column string, prob double, value double" + (f", low {WIDE}, high {WIDE}" if neighbours else ""))
    ranges = _refine_ranges(df, ranges, buckets, refine_limit, [t for t in targets])
    # C: value counts inside the target ranges only, ranked within range.  Each column is scanned by itself and held against its own
    # ranges alone: short code, one column read, and the scan may skip what lies outside
    keyed = list(ranges.items())
    own = ["value", "native"] if neighbours else ["value"]
    scans = []
    for c in sorted({c for (c, _, _), _ in keyed}):
        here = [(i, _inside(F.col(c).cast("double"), lo_v, hi_v)) for i, ((name, lo_v, hi_v), _) in enumerate(keyed) if name == c]
        bk = F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in here])
        scans.append(df.where(reduce(lambda x, y: x | y, [cond for _, cond in here])).select(
            bk.alias("bk"), F.col(c).cast("double").alias("value"), *([_native(df, c).alias("native")] if neighbours else [])))
    u = reduce(DataFrame.unionByName, scans)
    vc = u.groupBy("bk", *own).agg(F.count(F.lit(1)).alias("cnt"))
    of = F.create_map(*[v for i, ((c, _, _), info) in enumerate(keyed) for v in (F.lit(i), F.struct(F.lit(c).alias("column"), F.lit(info[0]).cast("bigint").alias("offset")))])
    vc = vc.withColumn("_of", of[F.col("bk")]).select("_of.*", "bk", *own, "cnt")
    w = Window.partitionBy("bk").orderBy(*own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = vc.withColumn("cum_cnt", F.col("offset") + F.sum("cnt").over(w)).withColumn(
        "n_before", F.col("cum_cnt") - F.col("cnt"))
    tg = spark.createDataFrame(targets, "_qcol string, prob double, h double, lo bigint, hi bigint")
    pos = tg.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("pos"))
    hit = ranked.join(F.broadcast(pos), (F.col("column") == F.col("_qcol")) &
                      (F.col("pos") >= F.col("n_before")) & (F.col("pos") < F.col("cum_cnt")))
    g = hit.groupBy("column", "prob", "h", "lo", "hi").agg(
        F.max(F.when(F.col("pos") == F.col("lo"), F.col("value"))).alias("lo_v"),
        F.max(F.when(F.col("pos") == F.col("hi"), F.col("value"))).alias("hi_v"),
        *([F.max(F.when(F.col("pos") == F.col(at), F.col("native"))).alias(name) for at, name in (("lo", "low"), ("hi", "high"))] if neighbours else []))
    # equal neighbours are the value itself: infinities do not weigh
    val = F.when((F.col("lo") == F.col("hi")) | (F.col("lo_v") == F.col("hi_v")), F.col("lo_v")).otherwise(
        (F.col("hi") - F.col("h")) * F.col("lo_v") + (F.col("h") - F.col("lo")) * F.col("hi_v"))
    more = ["low", "high"] if neighbours else []
    res = g.select("column", "prob", val.alias("value"), *more)
    empty = [c for c in cols if not n[c]]
    if empty:
        res = res.unionByName(spark.createDataFrame([(c, float(p), None) for c in empty for p in probs],
                                                    "column string, prob double, value double"), allowMissingColumns=True)
    return res


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact") -> DataFrame:
    """(column, prob, value).  ``exact`` = distributed rank selection;
    ``approx`` = ``percentile_approx`` (bounded sketch, one pass)."""
    if method == "exact":
        return exact_quantiles(df, cols, probs)
    if method != "approx":
        raise ValueError(method)
    spark = df.sparkSession
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), 10000).alias(c) for c in cols])
    st = stack_long(row, cols, value_type="array<double>", value_col="vals")
    pr = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "i int, prob double")
    return st.crossJoin(F.broadcast(pr)).select("column", "prob", F.element_at("vals", F.col("i") + 1).alias("value"))


def quantile_dict(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact") -> dict:
    """{(column, prob): value}; collects #cols × #probs rows."""
    if not cols:
        return {}
    return {(r["column"], round(r["prob"], 10)): r["value"] for r in quantiles(df, cols, probs, method).collect()}


def mid_ranks(df: DataFrame, value_col: str, partition_cols: list[str] | tuple = (),
              weight_cols: list[str] | tuple = ()) -> DataFrame:
    """Distinct values with count, average (mid) rank and running sums of
    extra weights: the ranking step of AUC and Mann-Whitney U."""
    part = list(partition_cols)
    g = df.where(F.col(value_col).isNotNull()).groupBy(*part, value_col).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(w).alias(w) for w in weight_cols])
    r = running_sum(g, value_col, ["cnt"], part)
    return r.withColumn("mid_rank", F.col("cum_cnt") - (F.col("cnt") - 1) / 2.0)
