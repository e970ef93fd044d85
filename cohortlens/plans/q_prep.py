"""Data-preparation queries: missing values, outliers, narrowing,
projections (D*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import hash_key, hash_key_sql
from ..operators import missing as MI
from ..operators import narrow as NA
from ..operators import outliers as OU
from ..operators.split import split_sql_expr, train_test_split
from . import fixtures as FX
from .registry import register
from .sqlgen import median_fill, per_col, union

ENC = FX.with_views("encounters")
SC = FX.with_views("scored")
ENC_KEYS = ["encounter_id", "patient_id", "seen_at", "appendicitis"]


def enc(s, d):
    return FX.encounters(s, d)


# ---- D1 / D2 ---------------------------------------------------------------

IMP_OUT = ["encounter_id"] + FX.LABS + ["us_finding"]
MODE_SEEN = "(SELECT v FROM (SELECT us_finding AS v, count(*) n FROM encounters WHERE us_finding IS NOT NULL " \
            "GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


def _imp(strategy):
    def q(s, d):
        out = MI.impute(enc(s, d), strategy, exclude=ENC_KEYS)
        return out.select(*IMP_OUT)
    return q


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) n FROM encounters WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v LIMIT 1)")


for strat, agg in [("median", "median({c})"), ("mean", "avg({c})"), ("mode", None)]:
    fills = ", ".join(f"coalesce({c}, {(agg.format(c=c) if agg else _mode_sql(c)) if agg is None else '(SELECT ' + agg.format(c=c) + ' FROM encounters)'}) AS {c}"
                      for c in FX.LABS)
    register(f"d01_impute_{strat}",
             ENC + f"SELECT encounter_id, {fills}, coalesce(us_finding, {MODE_SEEN}) AS us_finding FROM encounters",
             doubles=FX.LABS, family="missing")(_imp(strat))

register("d01_impute_drop",
         ENC + "SELECT " + ", ".join(IMP_OUT) + " FROM encounters WHERE " +
         " AND ".join(f"{c} IS NOT NULL" for c in FX.LABS + ["us_finding"]),
         doubles=FX.LABS, family="missing")(_imp("drop"))


def _q_d2(s, d):
    """The filled values of every column that had nulls, beside the count of nulls left in the row."""
    out, params = MI.prepare_impute(enc(s, d), exclude=["encounter_id"])
    left = sum([F.col(c).isNull().cast("bigint") for c in out.columns], F.lit(0).cast("bigint"))
    return out.select(*IMP_OUT, left.alias("remaining_nulls"))


register("d02_prepare_impute_check",
         ENC + "SELECT encounter_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM encounters)) AS {c}" for c in FX.LABS)
         + f", coalesce(us_finding, {MODE_SEEN}) AS us_finding, CAST(0 AS BIGINT) AS remaining_nulls FROM encounters",
         doubles=FX.LABS, family="missing")(_q_d2)


# ---- D3-D8 ------------------------------------------------------------------

def _d8(method, treatment, column_params=None):
    def q(s, d):
        _, st = OU.handle_outliers(enc(s, d), FX.CONTINUOUS, method, treatment, column_params)
        return st
    return q


def _bounds_sql(method, c):
    if method == "iqr":
        return (f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
                f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")
    if method == "percentile":
        return f"quantile_cont({c}, 0.01)", f"quantile_cont({c}, 0.99)"
    return f"avg({c}) - 3 * stddev_samp({c})", f"avg({c}) + 3 * stddev_samp({c})"


def _flag_sql(method, c):
    if method == "zscore":
        return f"coalesce(abs(({c} - m_{c}) / sd_{c}) > 3, false)"
    return f"coalesce({c} < lo_{c} OR {c} > hi_{c}, false)"


def _stats_cte(method, cols):
    parts = []
    for c in cols:
        lo, hi = _bounds_sql(method, c)
        parts.append(f"{lo} AS lo_{c}, {hi} AS hi_{c}, avg({c}) AS m_{c}, stddev_samp({c}) AS sd_{c}, "
                     f"median({c}) AS med_{c}, quantile_cont({c}, 0.05) AS q05_{c}, quantile_cont({c}, 0.95) AS q95_{c}")
    return "SELECT " + ", ".join(parts) + " FROM encounters"


def _d8_sql(plan: dict):
    """plan = {col: (method, treatment)}."""
    cols = list(plan)
    stats = " , ".join(f"b_{c} AS ({_stats_cte(plan[c][0], [c])})" for c in cols)
    joined = "encounters" + "".join(f", b_{c}" for c in cols)
    rem = " OR ".join(_flag_sql(plan[c][0], c) for c in cols if plan[c][1] == "remove") or "false"
    counts = ", ".join(f"count_if({_flag_sql(plan[c][0], c)}) AS n_{c}" for c in cols)
    agg = f"SELECT count(*) AS _rows, count_if({rem}) AS _removed, {counts} FROM {joined}"
    ntot = " + ".join(f"CAST(n_{c} > 0 AS INTEGER)" for c in cols)
    rows = union([f"SELECT '{c}' AS \"column\", '{plan[c][0]}' AS method, '{plan[c][1]}' AS treatment, n_{c} AS n_outliers, "
                  f"n_{c} * 100.0 / _rows AS pct_outliers, _removed AS rows_removed, {ntot} AS total_outlier_columns FROM a"
                  for c in cols])
    return ENC + ", " + stats + f", a AS ({agg}) " + rows


for meth, trt in [("iqr", "cap"), ("zscore", "mean"), ("percentile", "median")]:
    register(f"d08_outlier_stats_{meth}", _d8_sql({c: (meth, trt) for c in FX.CONTINUOUS}),
             doubles=["pct_outliers"], family="outliers")(_d8(meth, trt))

OVR = {"duration": {"method": "zscore", "treatment": "cap"},
       "c_reactive_protein": {"method": "percentile", "treatment": "remove"}}
register("d07_column_overrides",
         _d8_sql({c: (OVR.get(c, {}).get("method", "iqr"), OVR.get(c, {}).get("treatment", "cap")) for c in FX.CONTINUOUS}),
         doubles=["pct_outliers"], family="outliers")(_d8("iqr", "cap", OVR))


def _treat_sql(method, treatment, c):
    x = c
    if treatment == "cap":
        if method == "zscore":
            lo, hi = f"m_{c} - 3 * sd_{c}", f"m_{c} + 3 * sd_{c}"
        else:
            lo, hi = f"lo_{c}", f"hi_{c}"
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"
    if treatment == "mean":
        return f"CASE WHEN {_flag_sql(method, c)} THEN m_{c} ELSE {x} END"
    if treatment == "median":
        return f"CASE WHEN {_flag_sql(method, c)} THEN med_{c} ELSE {x} END"
    if treatment == "winsorize":
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, q05_{c}), q95_{c}) END"
    return x


def _treated_sql(method, treatment):
    cols = FX.CONTINUOUS
    stats = ", ".join(f"b_{c} AS ({_stats_cte(method, [c])})" for c in cols)
    joined = "encounters" + "".join(f", b_{c}" for c in cols)
    where = ""
    if treatment == "remove":
        where = " WHERE NOT (" + " OR ".join(_flag_sql(method, c) for c in cols) + ")"
    sel = ", ".join(f"{_treat_sql(method, treatment, c)} AS {c}" for c in cols)
    t = f"SELECT encounter_id, {sel} FROM {joined}{where}"
    return ENC + ", " + stats + f", t AS ({t}) " + per_col(
        cols, "SELECT '{c}' AS \"column\", count(*) AS n_rows, CAST(min({c}) AS DOUBLE) AS min, "
              "CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean FROM t")


def _treated(method, treatment):
    def q(s, d):
        from ..functions.ordering import stack_long
        out, _ = OU.handle_outliers(enc(s, d), FX.CONTINUOUS, method, treatment)
        long = stack_long(out, FX.CONTINUOUS)
        return long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("min"),
                                          F.max("value").alias("max"), F.avg("value").alias("mean"))
    return q


for meth, trt in [("iqr", "cap"), ("zscore", "cap"), ("zscore", "mean"), ("percentile", "median"),
                  ("iqr", "winsorize"), ("iqr", "remove")]:
    register(f"d06_treat_{meth}_{trt}", _treated_sql(meth, trt), doubles=["min", "max", "mean"],
             family="outliers")(_treated(meth, trt))


def _q_d9(s, d):
    from ..functions.ordering import stack_long
    out = OU.prep_zcap(enc(s, d), FX.CONTINUOUS)
    return stack_long(out, FX.CONTINUOUS).groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


register("d09_prep_zcap",
         ENC + ", t AS (SELECT " + ", ".join(
             f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, (SELECT avg({c}) - 3 * stddev_samp({c}) FROM encounters)), "
             f"(SELECT avg({c}) + 3 * stddev_samp({c}) FROM encounters)) END AS {c}" for c in FX.CONTINUOUS)
         + " FROM encounters) " + per_col(FX.CONTINUOUS, "SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, "
                                          "CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean FROM t"),
         doubles=["min", "max", "mean"], family="outliers")(_q_d9)

D10 = FX.CONTINUOUS + ["alvarado_score"]
register("d10_zscore_report",
         SC + "SELECT *, CASE WHEN pct_outliers > 5 THEN 'Investigate specific domain relationship with target' ELSE "
         "'Consider capping/flooring at 3 std devs' END AS advice FROM (" + per_col(
             D10, "SELECT '{c}' AS \"column\", count_if(abs(({c} - (SELECT avg({c}) FROM scored)) / "
                  "(SELECT stddev_pop({c}) FROM scored)) > 3) AS n_outliers, count_if(abs(({c} - (SELECT avg({c}) FROM scored)) / "
                  "(SELECT stddev_pop({c}) FROM scored)) > 3) * 100.0 / count(*) AS pct_outliers FROM scored")
         + ") t WHERE n_outliers > 0", doubles=["pct_outliers"], family="outliers")(
    lambda s, d: OU.zscore_report(FX.scored_encounters(s, d), D10))

DB = FX.CONTINUOUS + ["alvarado_score"]


def _dbscan_sql():
    parts = []
    for c in DB:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(CASE WHEN nb < 5 AND ncore = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) "
            f"AS n_noise FROM (SELECT z, nb, sum(CASE WHEN nb >= 5 THEN 1 ELSE 0 END) OVER (ORDER BY z RANGE BETWEEN 0.5 "
            f"PRECEDING AND 0.5 FOLLOWING) AS ncore FROM (SELECT z, count(*) OVER (ORDER BY z RANGE BETWEEN 0.5 PRECEDING "
            f"AND 0.5 FOLLOWING) AS nb FROM (SELECT ({c} - (SELECT avg({c}) FROM scored)) / (SELECT stddev_pop({c}) FROM scored)"
            f" AS z FROM scored WHERE {c} IS NOT NULL) z0) z1) z2")
    return SC + union(parts)


register("d12_dbscan_noise", _dbscan_sql(), family="outliers")(
    lambda s, d: OU.dbscan_noise_counts(FX.scored_encounters(s, d), DB))


def _d16(treatment):
    """Rows that any column's IQR fences flag, treated as whole rows."""
    def q(s, d):
        from ..functions.ordering import stack_long
        e = enc(s, d)
        b = OU.fit_bounds(e, FX.CONTINUOUS, "iqr", need_center=False)
        flag = F.lit(False)
        for c in FX.CONTINUOUS:
            flag = flag | OU.flag_expr(c, b[c], "iqr")
        out = OU.treat_flagged_rows(e.withColumn("_flag", flag), "_flag", FX.CONTINUOUS, treatment)
        return stack_long(out, FX.CONTINUOUS).groupBy("column").agg(
            *([] if treatment == "median" else [F.count("value").alias("n")]), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return q


def _d16_sql(treatment):
    cols = FX.CONTINUOUS
    stats = ", ".join(f"b_{c} AS ({_stats_cte('iqr', [c])})" for c in cols)
    moments = "mo AS (SELECT " + ", ".join(f"avg({c}) AS avg_{c}, stddev_samp({c}) AS dev_{c}" for c in cols) + " FROM encounters)"
    joined = "encounters, mo" + "".join(f", b_{c}" for c in cols)
    flag = " OR ".join(_flag_sql("iqr", c) for c in cols)
    value = {"median": "med_{c}", "mean": "avg_{c}", "remove": "{c}",
             "cap": "CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, avg_{c} - 3 * dev_{c}), avg_{c} + 3 * dev_{c}) END"}[treatment]
    sel = ", ".join(f"CASE WHEN {flag} THEN {value.format(c=c)} ELSE {c} END AS {c}" for c in cols)
    where = f" WHERE NOT coalesce({flag}, false)" if treatment == "remove" else ""
    n = "" if treatment == "median" else "count({c}) AS n, "
    return ENC + f", {moments}, {stats}, t AS (SELECT {sel} FROM {joined}{where}) " + per_col(
        cols, "SELECT '{c}' AS \"column\", " + n + "avg({c}) AS mean, CAST(max({c}) AS DOUBLE) AS max FROM t")


for _treatment, _name in [("median", "d16_treat_flagged_rows"), ("mean", "d16_flagged_rows_mean"), ("cap", "d16_flagged_rows_cap"),
                          ("remove", "d16_flagged_rows_remove")]:
    register(_name, _d16_sql(_treatment), doubles=["mean", "max"], family="outliers")(_d16(_treatment))


def _q_d17(s, d):
    e = FX.scored_encounters(s, d)
    sp = train_test_split(e, "encounter_id")
    st = OU.fit_reference_stats(sp.where(F.col("split") == "train"), D10)
    stats = {r["column"]: (r["mean"], r["sd"]) for r in st.collect()}
    out = OU.flag_against_stats(e, stats)
    return out.where(F.col("z_flag_count") > 0).select("encounter_id", "z_flag_count", "z_flagged")


def _d17_sql():
    tr = f"SELECT * FROM (SELECT *, {split_sql_expr('encounter_id')} AS split FROM scored) WHERE split = 'train'"
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in D10)
    z = {c: f"coalesce(abs(({c} - m_{c}) / s_{c}) > 3, false)" for c in D10}
    cnt = " + ".join(f"CAST({z[c]} AS INTEGER)" for c in D10)
    lst = ", ".join(f"CASE WHEN {z[c]} THEN '{c}' END" for c in D10)
    return (SC + f", st AS (SELECT {st} FROM ({tr}) t) SELECT * FROM (SELECT encounter_id, {cnt} AS z_flag_count, "
            f"concat_ws(',', {lst}) AS z_flagged FROM scored, st) WHERE z_flag_count > 0")


register("d17_flag_vs_stored_stats", _d17_sql(), family="outliers")(_q_d17)


# ---- D18-D20 narrowing -------------------------------------------------------

ENC_TYPES = {"encounter_id": "bigint", "patient_id": "bigint", "seen_at": "timestamp_ntz", "site": "string",
             "age": "double", "gender": "int", "duration": "double", "migration": "int", "anorexia": "int",
             "nausea": "int", "vomiting": "int", "right_lower_quadrant_pain": "int", "fever": "int",
             "rebound_tenderness": "int", "white_blood_cell_count": "double", "neutrophil_percentage": "double",
             "c_reactive_protein": "double", "us_finding": "string", "appendicitis": "int"}


def _case_map(expr, mapping, default):
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


TARGET = "appendicitis"          # never narrowed


def _narrow_sql(aggressive: bool) -> str:
    parts = []
    for c, t in ENC_TYPES.items():
        if c == TARGET:
            continue
        if t in NA.INT_TYPES:
            mn, mx = f"min({c})", f"max({c})"
            new = (f"CASE WHEN {mn} >= 0 THEN (CASE WHEN {mx} < 256 THEN 'uint8' WHEN {mx} < 65536 THEN 'uint16' "
                   f"WHEN {mx} < 4294967296 THEN 'uint32' ELSE 'uint64' END) WHEN {mn} > -128 AND {mx} < 128 THEN 'int8' "
                   f"WHEN {mn} > -32768 AND {mx} < 32768 THEN 'int16' WHEN {mn} > -2147483648 AND {mx} < 2147483648 "
                   f"THEN 'int32' ELSE 'int64' END")
        elif t in NA.FLOAT_TYPES:
            if aggressive:
                dec = f"max(length(split_part(CAST({c} AS VARCHAR), '.', 2)))"
                new = (f"CASE WHEN {dec} <= 3 AND min({c}) > -65500 AND max({c}) < 65500 THEN 'float16' "
                       f"WHEN {dec} <= 7 THEN 'float32' ELSE 'float64' END")
            else:
                new = "'float32'"
        elif t == "string":
            new = f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'category' ELSE 'object' END"
        else:
            new = f"'{t}'"
        zero = f"count_if({c} = 0) * 100.0 / count(*)" if t in NA.INT_TYPES + NA.FLOAT_TYPES else "CAST(NULL AS DOUBLE)"
        if t == "string":
            before = f"CAST(sum(strlen({c})) AS BIGINT)"
            after = f"CAST(CASE WHEN ({new}) = 'category' THEN count(*) * 4 ELSE sum(strlen({c})) END AS BIGINT)"
        else:
            before = f"CAST(count(*) * {NA.WIDTH.get(t, 8)} AS BIGINT)"
            after = f"CAST(count(*) * ({{w}}) AS BIGINT)"
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS original_type, {new} AS new_type, {before} AS bytes_before, "
                     f"{after} AS after_t, {zero} AS pct_zero FROM encounters")
    spark_of = {k: f"'{v}'" for k, v in NA.SPARK_OF.items()}
    inner = union(parts)
    st = _case_map("new_type", spark_of, "new_type")
    width = _case_map("spark_type", {k: str(v) for k, v in NA.WIDTH.items()}, "8")
    return (ENC + f", p0 AS ({inner}), p1 AS (SELECT *, {st} AS spark_type FROM p0) "
            f"SELECT \"column\", original_type, new_type, spark_type, bytes_before, "
            f"CAST(CASE WHEN original_type = 'string' THEN after_t ELSE bytes_before / {8} * 0 + "
            f"(SELECT count(*) FROM encounters) * {width} END AS BIGINT) AS bytes_after, "
            f"CAST(bytes_before - CASE WHEN original_type = 'string' THEN after_t ELSE "
            f"(SELECT count(*) FROM encounters) * {width} END AS BIGINT) AS saved_bytes, pct_zero, "
            f"coalesce(pct_zero > 50, false) AS sparse_candidate FROM p1")


def _fix_after(sql):
    return sql.replace("CAST(count(*) * ({w}) AS BIGINT)", "CAST(0 AS BIGINT)")


register("d18_narrowing_plan", _fix_after(_narrow_sql(False)), doubles=["pct_zero"], family="narrowing")(
    lambda s, d: NA.narrowing_plan(enc(s, d), exclude=[TARGET]))
register("d19_aggressive_narrowing_plan", _fix_after(_narrow_sql(True)), doubles=["pct_zero"], family="narrowing")(
    lambda s, d: NA.narrowing_plan(enc(s, d), aggressive=True, exclude=[TARGET]))
register("d20_narrowing_report_top15",
         "SELECT * FROM (" + _fix_after(_narrow_sql(False)) + ") r ORDER BY saved_bytes DESC, \"column\" LIMIT 15",
         doubles=["pct_zero"], family="narrowing")(lambda s, d: NA.narrowing_report(NA.narrowing_plan(enc(s, d), exclude=[TARGET])))
register("d19_savings_summary",
         "SELECT CAST(sum(bytes_before) AS BIGINT) AS bytes_before, CAST(sum(bytes_after) AS BIGINT) AS bytes_after, "
         "sum(bytes_before) / sum(bytes_after) AS ratio, count_if(sparse_candidate) AS n_sparse FROM ("
         + _fix_after(_narrow_sql(True)) + ") r", doubles=["ratio"], family="narrowing")(
    lambda s, d: NA.savings_summary(NA.narrowing_plan(enc(s, d), aggressive=True, exclude=[TARGET])))


# ---- P* projections / filters --------------------------------------------------

register("p01_select_features", SC + "SELECT " + ", ".join(FX.MODEL_FEATURES) + " FROM scored",
         doubles=["age", "duration"] + FX.LABS, family="projection")(
    lambda s, d: FX.scored_encounters(s, d).select(*FX.MODEL_FEATURES))


def _q_p2(s, d):
    from ..sources.tables import numeric_columns
    e = enc(s, d)
    return e.select(*numeric_columns(e))


NUMERIC_ENC = [c for c, t in ENC_TYPES.items() if t in ("bigint", "int", "double")]
register("p02_select_numeric", ENC + "SELECT " + ", ".join(NUMERIC_ENC) + " FROM encounters",
         doubles=[c for c in NUMERIC_ENC if ENC_TYPES[c] == "double"], family="projection")(_q_p2)

EXPECTED = ["encounter_id"] + FX.MODEL_FEATURES + ["temperature"]


def conform(df, expected, fill=0.0):
    """Add missing expected columns as ``fill`` (double), drop extra
    columns, fix the order; ``missing_features`` lists what was filled."""
    have = set(df.columns)
    missing = [c for c in expected if c not in have]
    out = [F.col(c) if c in have else F.lit(fill).cast("double").alias(c) for c in expected]
    return df.select(*out, F.lit(",".join(missing)).alias("missing_features"))


register("p03_conform_schema",
         ENC + "SELECT " + ", ".join(c if c in ENC_TYPES else f"CAST(0 AS DOUBLE) AS {c}" for c in EXPECTED)
         + ", 'pediatric_appendicitis_score,alvarado_score,temperature' AS missing_features FROM encounters",
         doubles=["age", "duration"] + FX.LABS + ["pediatric_appendicitis_score", "alvarado_score", "temperature"],
         family="projection")(lambda s, d: conform(enc(s, d), EXPECTED))

register("p04_drop_high_missing_columns", ENC + "SELECT * EXCLUDE (us_finding) FROM encounters",
         doubles=["age", "duration"] + FX.LABS, family="projection")(
    lambda s, d: MI.drop_high_missing_columns(enc(s, d), 30.0))

register("p05_dropna_subset",
         ENC + "SELECT encounter_id FROM encounters WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FX.LABS),
         family="projection")(lambda s, d: enc(s, d).dropna(subset=FX.LABS).select("encounter_id"))


def _q_p6(s, d):
    e = enc(s, d)
    b = OU.fit_bounds(e, FX.CONTINUOUS, "iqr", need_center=False)
    flag = F.lit(False)
    for c in FX.CONTINUOUS:
        flag = flag | OU.flag_expr(c, b[c], "iqr")
    return e.where(~flag).select("encounter_id")


def _p6_sql():
    cols = FX.CONTINUOUS
    stats = ", ".join(f"b_{c} AS ({_stats_cte('iqr', [c])})" for c in cols)
    joined = "encounters" + "".join(f", b_{c}" for c in cols)
    flag = " OR ".join(_flag_sql("iqr", c) for c in cols)
    return ENC + ", " + stats + f" SELECT encounter_id FROM {joined} WHERE NOT ({flag})"


register("p06_filter_non_outliers", _p6_sql(), family="projection")(_q_p6)


def _q_p9(s, d):
    from ..functions.stats import column_stats
    e = enc(s, d)
    cols = [c for c in NUMERIC_ENC if c not in ("encounter_id", "patient_id")]
    nc = MI.null_counts(e, cols)
    row = e.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    from ..functions.ordering import stack_long
    sd = stack_long(row, cols, value_col="std_samp")
    return nc.join(sd, "column").select("column", "pct_null", "std_samp",
                                        ((F.col("pct_null") <= 30) & (F.coalesce(F.col("std_samp"), F.lit(0.0)) > 0))
                                        .alias("eligible"))


P9 = [c for c in NUMERIC_ENC if c not in ("encounter_id", "patient_id")]
register("p09_outlier_eligible_columns",
         ENC + per_col(P9, "SELECT '{c}' AS \"column\", (count(*) - count({c})) * 100.0 / count(*) AS pct_null, "
                       "stddev_samp({c}) AS std_samp, (count(*) - count({c})) * 100.0 / count(*) <= 30 AND "
                       "coalesce(stddev_samp({c}), 0) > 0 AS eligible FROM encounters"),
         doubles=["pct_null", "std_samp"], family="projection")(_q_p9)

register("p10_label_filtered_means",
         ENC + "SELECT " + ", ".join(f"avg({c}) FILTER (WHERE appendicitis = 1) AS pos_{c}, "
                                     f"avg({c}) FILTER (WHERE appendicitis = 0) AS neg_{c}" for c in FX.LABS)
         + " FROM encounters", doubles=[f"{p}_{c}" for c in FX.LABS for p in ("pos", "neg")], family="projection")(
    lambda s, d: enc(s, d).agg(*[e for c in FX.LABS for e in (
        F.avg(F.when(F.col("appendicitis") == 1, F.col(c))).alias(f"pos_{c}"),
        F.avg(F.when(F.col("appendicitis") == 0, F.col(c))).alias(f"neg_{c}"))]))


def hash_sample(df, id_col, n, seed=42):
    """Exactly n rows, the smallest seeded hash keys (a distributed
    top-n: per-task top-n then one merge of n·tasks rows)."""
    return df.withColumn("_hk", hash_key(id_col, seed)).orderBy("_hk", id_col).limit(n).drop("_hk")


register("p11_hash_sample_100",
         ENC + f"SELECT encounter_id, age FROM encounters ORDER BY {hash_key_sql('encounter_id')}, encounter_id LIMIT 100",
         doubles=["age"], family="projection")(lambda s, d: hash_sample(enc(s, d), "encounter_id", 100)
                                                .select("encounter_id", "age"))

# Field rules of the entry form (field, min, max, required).
FIELD_RULES = [
    ("age", 1, 18, True), ("duration", 0, 120, True), ("white_blood_cell_count", 0, 40, True),
    ("neutrophil_percentage", 0, 100, True), ("c_reactive_protein", 0, 300, True),
    ("pediatric_appendicitis_score", 0, 10, False), ("alvarado_score", 0, 10, False),
    ("gender", 0, 1, True), ("migration", 0, 1, False), ("anorexia", 0, 1, False), ("nausea", 0, 1, False),
    ("vomiting", 0, 1, False), ("right_lower_quadrant_pain", 0, 1, False), ("fever", 0, 1, False),
    ("rebound_tenderness", 0, 1, False),
]


def validate_rows(df, rules=FIELD_RULES):
    """Violation names per row (missing required / out of range) and a
    clean flag; rules are a bounded list (one entry per form field)."""
    v = []
    for f, lo, hi, req in rules:
        x = F.col(f)
        e = F.when((x < lo) | (x > hi), F.lit(f))
        if req:
            e = F.when(x.isNull(), F.lit(f"{f}:missing")).otherwise(e)
        v.append(e)
    viol = F.concat_ws(",", *v)
    return df.select("*", viol.alias("violations"), (viol == "").alias("is_clean"))


# The same rules written out for the oracle, independent of the list above.
VIOLATIONS_SQL = """concat_ws(',',
  CASE WHEN age IS NULL THEN 'age:missing' WHEN NOT age BETWEEN 1 AND 18 THEN 'age' END,
  CASE WHEN duration IS NULL THEN 'duration:missing' WHEN NOT duration BETWEEN 0 AND 120 THEN 'duration' END,
  CASE WHEN white_blood_cell_count IS NULL THEN 'white_blood_cell_count:missing' WHEN NOT white_blood_cell_count BETWEEN 0 AND 40 THEN 'white_blood_cell_count' END,
  CASE WHEN neutrophil_percentage IS NULL THEN 'neutrophil_percentage:missing' WHEN NOT neutrophil_percentage BETWEEN 0 AND 100 THEN 'neutrophil_percentage' END,
  CASE WHEN c_reactive_protein IS NULL THEN 'c_reactive_protein:missing' WHEN NOT c_reactive_protein BETWEEN 0 AND 300 THEN 'c_reactive_protein' END,
  CASE WHEN NOT pediatric_appendicitis_score BETWEEN 0 AND 10 THEN 'pediatric_appendicitis_score' END,
  CASE WHEN NOT alvarado_score BETWEEN 0 AND 10 THEN 'alvarado_score' END,
  CASE WHEN gender IS NULL THEN 'gender:missing' WHEN gender NOT IN (0, 1) THEN 'gender' END,
  CASE WHEN migration NOT IN (0, 1) THEN 'migration' END,
  CASE WHEN anorexia NOT IN (0, 1) THEN 'anorexia' END,
  CASE WHEN nausea NOT IN (0, 1) THEN 'nausea' END,
  CASE WHEN vomiting NOT IN (0, 1) THEN 'vomiting' END,
  CASE WHEN right_lower_quadrant_pain NOT IN (0, 1) THEN 'right_lower_quadrant_pain' END,
  CASE WHEN fever NOT IN (0, 1) THEN 'fever' END,
  CASE WHEN rebound_tenderness NOT IN (0, 1) THEN 'rebound_tenderness' END)"""


def _p13_sql():
    return SC + f"SELECT encounter_id, {VIOLATIONS_SQL} AS violations, {VIOLATIONS_SQL} = '' AS is_clean FROM scored"


register("p13_row_validation", _p13_sql(), family="projection")(
    lambda s, d: validate_rows(FX.scored_encounters(s, d)).select("encounter_id", "violations", "is_clean"))


def _q_dbscan_stats(s, d):
    _, st = OU.handle_outliers_model(FX.scored_encounters(s, d), DB, "dbscan", "encounter_id", "cap")
    return st.select("column", "method", "treatment", "n_outliers")


register("d08_outlier_stats_dbscan",
         SC + "SELECT \"column\", 'dbscan' AS method, 'cap' AS treatment, n_noise AS n_outliers FROM (" +
         _dbscan_sql()[len(SC):] + ") t", family="outliers")(_q_dbscan_stats)


def _q_iforest_stats(s, d):
    e = FX.encounters(s, d)
    _, st = OU.handle_outliers_model(e, FX.CONTINUOUS, "isolation_forest", "encounter_id", "cap")
    return st


register("d08_outlier_stats_isolation_forest", family="outliers")(_q_iforest_stats)


def _q_w7(s, d):
    nc = OU.neighbour_counts(FX.scored_encounters(s, d), DB)
    return nc.groupBy("column").agg(F.sum("cnt").cast("bigint").alias("n_rows"),
                                    F.sum(F.col("cnt") * F.col("in_range")).cast("bigint").alias("sum_neighbours"),
                                    F.max("in_range").cast("bigint").alias("max_neighbours"))


def _w7_sql():
    return SC + union([
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, CAST(sum(nb) AS BIGINT) AS sum_neighbours, "
        f"CAST(max(nb) AS BIGINT) AS max_neighbours FROM (SELECT count(*) OVER (ORDER BY z RANGE BETWEEN 0.5 PRECEDING "
        f"AND 0.5 FOLLOWING) AS nb FROM (SELECT ({c} - (SELECT avg({c}) FROM scored)) / (SELECT stddev_pop({c}) FROM scored)"
        f" AS z FROM scored WHERE {c} IS NOT NULL) z0) z1" for c in DB])


register("w7_neighbour_counts_within_eps", _w7_sql(), family="windows")(_q_w7)
