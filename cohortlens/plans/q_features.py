"""Feature-engineering, encoding, scaling, split and statistical-test
queries (E*, H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import hash_key_sql, stack_long
from ..operators import encode as EN
from ..operators import features as FE
from ..operators import stats_tests as ST
from ..operators.split import split_sql_expr, train_test_split
from . import fixtures as FX
from .registry import register
from .sqlgen import CLINICAL_FEATURES_SQL, LAB_COMPOSITE_SQL, per_col, union

SC = FX.with_views("scored")
ENC = FX.with_views("encounters")


def sc(s, d):
    return FX.scored_encounters(s, d)


FEAT_OUT = ["symptom_count", "absolute_neutrophils", "classic_triad", "localized_pain_with_fever",
            "lab_composite_score", "alvarado_risk"]
register("e01_e06_clinical_features", SC + f"SELECT encounter_id, {CLINICAL_FEATURES_SQL} FROM scored",
         doubles=["absolute_neutrophils", "lab_composite_score"], family="features")(
    lambda s, d: FE.clinical_features(sc(s, d)).select("encounter_id", *FEAT_OUT))


def _q_e5b(s, d):
    e = sc(s, d)
    tr = train_test_split(e, "encounter_id").where("split = 'train'")
    from ..functions.stats import column_stats
    st = column_stats(tr, FX.LABS, ["mean", "std_pop"])
    stats = {c: (st[c]["mean"], st[c]["std_pop"]) for c in FX.LABS}
    return e.select("encounter_id", FE.lab_zscore_composite(stats))


def _e5b_sql():
    tr = f"SELECT * FROM (SELECT *, {split_sql_expr('encounter_id')} AS split FROM scored) WHERE split = 'train'"
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FX.LABS)
    z = [f"({c} - m_{c}) / s_{c}" for c in FX.LABS]
    num = " + ".join(f"coalesce({x}, 0.0)" for x in z)
    den = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in FX.LABS)
    return SC + f", st AS (SELECT {st} FROM ({tr}) t) SELECT encounter_id, ({num}) / NULLIF({den}, 0) AS lab_composite_score FROM scored, st"


register("e05b_lab_zscore_composite", _e5b_sql(), doubles=["lab_composite_score"], family="features")(_q_e5b)

register("e06b_alvarado_risk_bins",
         SC + "SELECT encounter_id, CASE WHEN alvarado_score > 0 AND alvarado_score <= 4 THEN 0 WHEN alvarado_score > 4 AND "
         "alvarado_score <= 6 THEN 1 WHEN alvarado_score > 6 AND alvarado_score <= 10 THEN 2 END AS alvarado_risk FROM scored",
         family="features")(lambda s, d: sc(s, d).select("encounter_id", FE.alvarado_risk_b()))

register("e07_wbc_neutrophil_ratio",
         SC + "SELECT encounter_id, white_blood_cell_count / NULLIF(neutrophil_percentage, 0) AS wbc_neutrophil_ratio FROM scored",
         doubles=["wbc_neutrophil_ratio"], family="features")(
    lambda s, d: sc(s, d).select("encounter_id", FE.wbc_neutrophil_ratio()))

register("e08_point_score",
         ENC + f"SELECT encounter_id, CAST({FX.POINT_SCORE_SQL} AS INTEGER) AS point_score FROM encounters",
         family="features")(lambda s, d: FX.encounters(s, d).select("encounter_id", FE.point_score().alias("point_score")))

register("e09_rule_probability",
         SC + "SELECT encounter_id, least(greatest(alvarado_score / 10.0, 0.05), 0.95) AS rule_probability, "
         "CAST(least(greatest(alvarado_score / 10.0, 0.05), 0.95) > 0.5 AS INTEGER) AS rule_class FROM scored",
         doubles=["rule_probability"], family="features")(
    lambda s, d: FE.rule_score(sc(s, d)).select("encounter_id", "rule_probability", "rule_class"))

_E10 = {"right_lower_quadrant_pain": "right_lower_quadrant_pain = 1", "white_blood_cell_count": "white_blood_cell_count > 10",
        "neutrophil_percentage": "neutrophil_percentage > 75", "fever": "fever = 1", "duration": "duration > 24"}
register("e10_rule_contributions",
         SC + union([f"SELECT encounter_id, '{f}' AS feature, CAST(CASE WHEN coalesce({_E10[f]}, false) THEN {m} ELSE -{m} END AS DOUBLE) "
                     f"AS contribution FROM scored" for f, m in FE.RULE_CONTRIBUTIONS]),
         doubles=["contribution"], family="features")(lambda s, d: FE.rule_contributions(sc(s, d), "encounter_id"))


def _weak_sql():
    t = []
    for c, w, thr in FE.WEAK_LABEL_WEIGHTS:
        t.append(f"coalesce({c}, 0) * CAST({w} AS DOUBLE)" if thr is None
                 else f"CAST(coalesce({c} > {thr}, false) AS INTEGER) * CAST({w} AS DOUBLE)")
    return " + ".join(t)


register("e11_weak_label",
         SC + f", w AS (SELECT encounter_id, {_weak_sql()} AS r FROM scored) SELECT encounter_id, r / (SELECT max(r) FROM w) "
         "AS weak_score, CAST(r / (SELECT max(r) FROM w) > 0.5 AS INTEGER) AS weak_label FROM w",
         doubles=["weak_score"], family="features")(
    lambda s, d: FE.weak_label(sc(s, d)).select("encounter_id", "weak_score", "weak_label"))


def _logit_sql():
    t = [f"(({c} - CAST({s_} AS DOUBLE)) / CAST({d_} AS DOUBLE)) * CAST({w} AS DOUBLE)" for c, w, s_, d_ in FE.LOGIT_TERMS]
    return "1.0 / (1.0 + exp(-(" + " + ".join(t) + f" + CAST({FE.LOGIT_OFFSET} AS DOUBLE))))"


register("e12_logit_positive_rate",
         SC + f", p AS (SELECT {_logit_sql()} AS p FROM scored) SELECT avg(p) AS mean_probability, "
         "avg(CAST(p > 0.5 AS DOUBLE)) AS positive_rate, avg(CAST(p > 0.5 AS DOUBLE)) BETWEEN 0.4 AND 0.6 AS balanced FROM p",
         doubles=["mean_probability", "positive_rate"], family="features")(
    lambda s, d: sc(s, d).select(FE.logit_probability().alias("p")).agg(
        F.avg("p").alias("mean_probability"), F.avg((F.col("p") > 0.5).cast("double")).alias("positive_rate"))
    .withColumn("balanced", F.col("positive_rate").between(0.4, 0.6)))

SITES = ["click", "error", "purchase", "signup", "view"]


def _q_e13(s, d):
    e = FX.encounters(s, d).select("encounter_id", "site", "us_finding")
    return EN.one_hot(e, EN.fit_levels(e, ["site", "us_finding"]), drop_first=True)


register("e13_one_hot_drop_first",
         ENC + "SELECT encounter_id, " + ", ".join(f"CAST(coalesce(site = '{v}', false) AS INTEGER) AS site_{v}" for v in SITES[1:])
         + " FROM encounters", family="encoding")(_q_e13)


def _q_e14(s, d):
    e = FX.encounters(s, d).select("encounter_id", "site")
    tr = e.where("site <> 'view'")          # levels seen in training only
    return EN.one_hot(e, EN.fit_levels(tr, ["site"]), drop_first=False)


register("e14_one_hot_ignore_unknown",
         ENC + "SELECT encounter_id, " + ", ".join(f"CAST(coalesce(site = '{v}', false) AS INTEGER) AS site_{v}" for v in SITES[:-1])
         + " FROM encounters", family="encoding")(_q_e14)

E15 = [c for c in FX.MODEL_FEATURES]


def _e15_sql():
    pairs = [(i, a, b) for i, a in enumerate(E15) for b in E15[i + 1:]]
    u = union([f"SELECT '{b}' AS col_b, '{a}' AS col_a, {i} AS ai, corr({a}, {b}) AS r FROM scored" for i, a, b in pairs])
    return SC + f"SELECT col_b AS \"column\", arg_min(col_a, ai) AS because_of FROM ({u}) t WHERE abs(r) > 0.7 GROUP BY col_b"


register("e15_correlated_to_drop", _e15_sql(), family="selection")(
    lambda s, d: EN.correlated_to_drop(sc(s, d), E15))

E16 = ["age", "duration"] + FX.LABS


def _q_e16(s, d):
    sp = train_test_split(sc(s, d), "encounter_id")
    params = EN.fit_standard(sp.where("split = 'train'"), E16)
    out = EN.apply_standard(sp.select("split", *E16), params)
    long = stack_long(out, E16, keep=["split"])
    return long.groupBy("split", "column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _e16_sql():
    sp = f"SELECT *, {split_sql_expr('encounter_id')} AS split FROM scored"
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in E16)
    return (SC + f", sp AS ({sp}), st AS (SELECT {st} FROM sp WHERE split = 'train'), z AS (SELECT split, "
            + ", ".join(f"({c} - m_{c}) / NULLIF(s_{c}, 0) AS {c}" for c in E16) + " FROM sp, st) "
            + union([f"SELECT split, '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std FROM z GROUP BY split"
                     for c in E16]))


register("e16_standard_scaling_train_fit", _e16_sql(), doubles=["mean", "std"], family="scaling")(_q_e16)


def _q_e17(s, d):
    e = sc(s, d).select(*FX.LABS)
    out = EN.apply_minmax(e, EN.fit_minmax(e, FX.LABS), 0.0, 2.0)
    return stack_long(out, FX.LABS).groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                                            F.avg("value").alias("mean"))


register("e17_minmax_scaling",
         SC + per_col(FX.LABS, "SELECT '{c}' AS \"column\", min(v) AS min, max(v) AS max, avg(v) AS mean FROM "
                      "(SELECT ({c} - (SELECT min({c}) FROM scored)) / ((SELECT max({c}) FROM scored) - (SELECT min({c}) "
                      "FROM scored)) * 2.0 + 0.0 AS v FROM scored) t"),
         doubles=["min", "max", "mean"], family="scaling")(_q_e17)


def _e18_sql():
    grid = EN.yeo_johnson_grid()
    g = union([f"SELECT CAST({v} AS DOUBLE) AS lambda" for v in grid])
    yj = ("CASE WHEN value >= 0 THEN (CASE WHEN abs(lambda) < 1e-12 THEN ln(1 + value) ELSE (pow(value + 1, lambda) - 1) / lambda END)"
          " ELSE (CASE WHEN abs(lambda - 2) < 1e-12 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - lambda) - 1) / (2 - lambda) END) END")
    long = union([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM scored WHERE {c} IS NOT NULL" for c in FX.CONTINUOUS])
    return (SC + f", g AS ({g}), l AS ({long}), t AS (SELECT \"column\", lambda, {yj} AS y, sign(value) * ln(1 + abs(value)) AS sl "
            "FROM l, g), a AS (SELECT \"column\", lambda, -count(*) / 2.0 * ln(var_pop(y)) + (lambda - 1) * sum(sl) AS llf FROM t "
            "GROUP BY 1, 2) SELECT \"column\", lambda, llf FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY llf DESC, "
            "lambda) AS r FROM a) WHERE r = 1").replace("lambda", '"lambda"')


register("e18_yeo_johnson_lambda", _e18_sql(), doubles=["lambda", "llf"], family="scaling")(
    lambda s, d: EN.fit_yeo_johnson(sc(s, d), FX.CONTINUOUS))

E19 = ["age", "duration", "white_blood_cell_count"]
_E19_OUT = [(a, b) for i, a in enumerate(E19) for b in E19[i:]]


def _q_e19(s, d):
    p = EN.polynomial2(sc(s, d), E19)
    return p.agg(*[F.sum(F.col(f"`{c}`")).alias(f"sum_{i}") for i, c in enumerate(p.columns)])


register("e19_polynomial_degree2",
         SC + "SELECT " + ", ".join([f"sum({c}) AS sum_{i}" for i, c in enumerate(E19)]
                                    + [f"sum({a} * {b}) AS sum_{len(E19) + j}" for j, (a, b) in enumerate(_E19_OUT)])
         + " FROM scored", doubles=[f"sum_{i}" for i in range(len(E19) + len(_E19_OUT))], family="features")(_q_e19)

E21 = [c for c in FX.MODEL_FEATURES]


def _anova_sql(cols):
    return union([
        f"SELECT '{c}' AS \"column\", ((sum(s * s / n) - pow(sum(s), 2) / sum(n)) / (count(*) - 1)) / NULLIF(((sum(ss) - "
        f"pow(sum(s), 2) / sum(n)) - (sum(s * s / n) - pow(sum(s), 2) / sum(n))) / (sum(n) - count(*)), 0) AS f_stat FROM "
        f"(SELECT appendicitis, count({c}) AS n, sum({c}) AS s, sum({c} * {c}) AS ss FROM scored WHERE {c} IS NOT NULL "
        f"GROUP BY 1) g" for c in cols])


register("e21_select_k_best_anova",
         SC + f"SELECT *, rank <= 4 AS selected FROM (SELECT *, row_number() OVER (ORDER BY f_stat DESC, \"column\") AS rank "
         f"FROM ({_anova_sql(E21)}) a) b", doubles=["f_stat"], family="selection")(
    lambda s, d: EN.select_k_best(sc(s, d), E21, "appendicitis", 4))

register("h3_anova_f", SC + _anova_sql(E21), doubles=["f_stat"], family="stats")(
    lambda s, d: EN.anova_f(sc(s, d), E21, "appendicitis"))

register("e23_random_split",
         ENC + f"SELECT encounter_id, {split_sql_expr('encounter_id')} AS split FROM encounters", family="split")(
    lambda s, d: train_test_split(FX.encounters(s, d), "encounter_id").select("encounter_id", "split"))

register("e24_stratified_split_70_30",
         ENC + f"SELECT encounter_id, appendicitis, {split_sql_expr('encounter_id', 0.3, partition='appendicitis')} AS split "
         "FROM encounters", family="split")(
    lambda s, d: train_test_split(FX.encounters(s, d), "encounter_id", 0.3, stratify="appendicitis")
    .select("encounter_id", "appendicitis", "split"))

H = FX.CONTINUOUS + ["alvarado_score"]


def _mw_sql():
    long = union([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, appendicitis FROM scored WHERE {c} IS NOT NULL"
                  for c in H])
    phi = ("(exp(-z * z / 2.0) / sqrt(2 * 3.141592653589793) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + "
           "t * (-1.821255978 + t * 1.330274429))))))")
    return (SC + f", l AS ({long}), r AS (SELECT \"column\", value, appendicitis, rank() OVER (PARTITION BY \"column\" ORDER BY value) + "
            "(count(*) OVER (PARTITION BY \"column\", value) - 1) / 2.0 AS mr FROM l), "
            "ties AS (SELECT \"column\", sum(pow(c, 3) - c) AS tie FROM (SELECT \"column\", value, count(*) AS c FROM l GROUP BY 1, 2) "
            "GROUP BY 1), g AS (SELECT \"column\", sum(CASE WHEN appendicitis = 1 THEN mr ELSE 0 END) AS R1, "
            "count_if(appendicitis = 1) AS n1, count(*) AS n FROM r GROUP BY 1), "
            "u AS (SELECT g.\"column\", R1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * (n - n1) / 2.0 AS mu, "
            "sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - tie / (n * (n - 1)))) AS sigma FROM g JOIN ties USING (\"column\")), "
            "zz AS (SELECT *, abs(u1 - mu) / sigma AS z, 1.0 / (1.0 + 0.2316419 * abs(u1 - mu) / sigma) AS t FROM u) "
            f"SELECT \"column\", u1 AS u_stat, (u1 - mu) / sigma AS z, least(1.0, 2 * {phi}) AS p_value, "
            f"least(1.0, 2 * {phi}) < 0.05 AS significant FROM zz")


register("h1_mann_whitney", _mw_sql(), doubles=["u_stat", "z", "p_value"], family="stats")(
    lambda s, d: ST.mann_whitney(sc(s, d), H, "appendicitis"))

register("h2_welch_t",
         SC + union([f"SELECT '{c}' AS \"column\", (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t_stat, pow(v1 / n1 + v0 / n0, 2) / "
                     f"(pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM (SELECT "
                     f"count({c}) FILTER (WHERE appendicitis = 1) AS n1, avg({c}) FILTER (WHERE appendicitis = 1) AS m1, "
                     f"var_samp({c}) FILTER (WHERE appendicitis = 1) AS v1, count({c}) FILTER (WHERE appendicitis = 0) AS n0, "
                     f"avg({c}) FILTER (WHERE appendicitis = 0) AS m0, var_samp({c}) FILTER (WHERE appendicitis = 0) AS v0 "
                     f"FROM scored) g" for c in H]),
         doubles=["t_stat", "df"], family="stats")(lambda s, d: ST.welch_t(sc(s, d), H, "appendicitis"))


register("h2_welch_t_p_values", family="stats")(
    lambda s, d: ST.welch_t_test(sc(s, d), H, "appendicitis"))


def _q_e18_power(s, d):
    """E18 whole: lambda by bracketed search, transform, standardise; no worse than the best of the grid."""
    from ..session import written
    e = written(sc(s, d).select(*FX.CONTINUOUS), "power")
    params = EN.fit_power(e, FX.CONTINUOUS)
    out = stack_long(EN.apply_power(e, params), FX.CONTINUOUS).groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    grid = {r["column"]: r["lambda"] for r in EN.fit_yeo_johnson(e, FX.CONTINUOUS).collect()}
    near = F.create_map(*[x for c in FX.CONTINUOUS for x in (F.lit(c), F.lit(abs(params[c][0] - grid[c]) <= 0.05))])
    return out.withColumn("near_grid", near[F.col("column")])


register("e18_power_transform", SC + per_col(FX.CONTINUOUS, "SELECT '{c}' AS \"column\", count({c}) AS n, 0.0 AS mean, 1.0 AS sd, true AS near_grid FROM scored"),
         doubles=["mean", "sd"], family="scaling")(_q_e18_power)

SPARSE = ["site", "us_finding", "patient_id"]


def _sparse(drop_first):
    def run(s, d):
        e = FX.encounters(s, d).select("encounter_id", *SPARSE)
        known = EN.level_dictionary(e.where("site <> 'view'"), SPARSE, drop_first)  # levels seen in training only
        return EN.sparse_one_hot(e, SPARSE, known).select("encounter_id", F.array_join("indices", ",").alias("indices"))
    return run


def _sparse_sql(drop_first):
    skip = int(drop_first)
    levels = union([f"SELECT DISTINCT {i} AS k, CAST({c} AS VARCHAR) AS level FROM encounters WHERE site <> 'view' AND {c} IS NOT NULL" for i, c in enumerate(SPARSE)])
    cells = union([f"SELECT encounter_id, {i} AS k, CAST({c} AS VARCHAR) AS level FROM encounters" for i, c in enumerate(SPARSE)])
    return (ENC + f", l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level) AS place FROM ({levels}) u), i AS (SELECT k, level, "
            f"row_number() OVER (ORDER BY k, level) - 1 AS idx FROM l WHERE place > {skip}), c AS ({cells}) SELECT c.encounter_id, "
            "coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx), '') AS indices FROM c LEFT JOIN i ON i.k = c.k AND i.level = c.level GROUP BY 1")


register("e14_sparse_one_hot_dictionary", _sparse_sql(False), family="encoding")(_sparse(False))
register("e13_sparse_one_hot_drop_first", _sparse_sql(True), family="encoding")(_sparse(True))
