"""Feedback, attribution, windows, joins, set operations and scalar
functions (B*, A19-A23, X*, W1/W6/W8/W9, T1/T2, J*, U*, F*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as SF
from ..functions.ordering import hash_key_sql, stack_long
from ..operators import explain as XP
from ..operators import features as FE
from ..operators import feedback as FB
from ..operators import outliers as OU
from ..operators import profile as PR
from ..operators.missing import impute
from ..operators.split import growing_subsets
from ..sources.tables import read_table
from . import fixtures as FX
from .q_prep import _flag_sql, _stats_cte
from .registry import register
from .sqlgen import median_fill, per_col, union

FBV = FX.with_views("feedback")
SC = FX.with_views("scored")
ENC = FX.with_views("encounters")


def fb(s, d):
    return FX.feedback(s, d)


# ---- feedback ------------------------------------------------------------------

def _summary_sql(col):
    return (f"SELECT count(*) AS n, avg(r) AS mean, median(r) AS median, count_if(r <= 2) AS n_low, count_if(r >= 4) AS n_high "
            f"FROM (SELECT TRY_CAST({col} AS DOUBLE) AS r FROM feedback) t")


register("b1_a19_accuracy_summary", FBV + _summary_sql("diagnostic_accuracy"), doubles=["mean", "median"],
         family="feedback")(lambda s, d: FB.rating_summary(fb(s, d), "diagnostic_accuracy"))

_CONC = " ".join(f"WHEN prediction_class = '{p}' AND actual_diagnosis = '{a}' THEN '{lab}'" for p, a, lab in FB.CONCORDANCE)
register("b1_a20_concordance",
         FBV + f"SELECT CASE {_CONC} ELSE '{FB.UNDETERMINED}' END AS concordance, count(*) AS n FROM feedback GROUP BY 1",
         family="feedback")(lambda s, d: FB.concordance(fb(s, d)))

register("b2_a21_a22_usefulness_report",
         FBV + f"SELECT * FROM ({_summary_sql('usefulness_rating')}) s, (SELECT corr(x, y) AS corr, regr_slope(y, x) AS slope, "
         "regr_intercept(y, x) AS intercept FROM (SELECT TRY_CAST(diagnostic_accuracy AS DOUBLE) AS x, "
         "TRY_CAST(usefulness_rating AS DOUBLE) AS y FROM feedback) t) c",
         doubles=["mean", "median", "corr", "slope", "intercept"], family="feedback")(
    lambda s, d: FB.usefulness_report(fb(s, d)))

register("a23_rating_histogram",
         FBV + "SELECT CAST(least(floor((r - 1.0) / 0.8) + 1, 5) AS INTEGER) AS bin, count(*) AS n FROM "
         "(SELECT TRY_CAST(diagnostic_accuracy AS DOUBLE) AS r FROM feedback) t WHERE r IS NOT NULL GROUP BY 1",
         family="feedback")(lambda s, d: FB.rating_histogram(fb(s, d), "diagnostic_accuracy"))

B3 = ["report_id", "prediction_class", "prediction_probability", "diagnostic_accuracy", "usefulness_rating",
      "actual_diagnosis", "other_diagnosis"]
register("b3_b4_report_details",
         FBV + "SELECT " + ", ".join(
             "coalesce(CASE WHEN actual_diagnosis = 'autre' THEN other_diagnosis END, 'N/A') AS other_diagnosis"
             if c == "other_diagnosis" else f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}" for c in B3) + " FROM feedback",
         family="feedback")(lambda s, d: FB.report_details(fb(s, d), B3))

register("p08_comment_samples",
         FBV + "SELECT report_id, CASE WHEN length(comments) > 100 THEN substr(comments, 1, 100) || '...' ELSE comments END "
         "AS comment FROM feedback WHERE comments IS NOT NULL AND trim(comments) <> '' ORDER BY report_id LIMIT 5",
         family="feedback")(lambda s, d: FB.comment_samples(fb(s, d)))


def _q_j9(s, d):
    e = FE.rule_score(FX.scored_encounters(s, d)).select(F.col("encounter_id").alias("report_id"), "rule_probability")
    f = fb(s, d).select("report_id", F.lit(True).alias("_fb"))
    j = e.join(f, "report_id", "left")
    return j.groupBy(F.coalesce(F.col("_fb"), F.lit(False)).alias("has_feedback")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rule_probability").alias("avg_probability"))


register("j09_predictions_vs_feedback",
         FX.with_views("scored", "feedback") + "SELECT f.report_id IS NOT NULL AS has_feedback, count(*) AS n, "
         "avg(least(greatest(s.alvarado_score / 10.0, 0.05), 0.95)) AS avg_probability FROM scored s LEFT JOIN feedback f "
         "ON s.encounter_id = f.report_id GROUP BY 1", doubles=["avg_probability"], family="joins")(_q_j9)

register("j09_reports_without_feedback_anti",
         FX.with_views("scored", "feedback") + "SELECT encounter_id FROM scored s WHERE NOT EXISTS "
         "(SELECT 1 FROM feedback f WHERE f.report_id = s.encounter_id)", family="joins")(
    lambda s, d: FX.scored_encounters(s, d).select("encounter_id").join(
        fb(s, d).select(F.col("report_id").alias("encounter_id")), "encounter_id", "left_anti"))

# ---- attribution -------------------------------------------------------------------

LIN_W = {c: w / dv for c, w, sh, dv in FE.LOGIT_TERMS}
LIN_B = FE.LOGIT_OFFSET - sum(w * sh / dv for c, w, sh, dv in FE.LOGIT_TERMS)
LIN_F = list(LIN_W)


def _imp(s, d):
    return impute(FX.scored_encounters(s, d), "median", cols=FX.LABS)


def contributions(s, d):
    e = _imp(s, d)
    return XP.linear_shapley(e, LIN_W, LIN_B, "encounter_id", XP.background_means(e, LIN_F))


def _dbl(x):
    return f"CAST({x!r} AS DOUBLE)"


_BASE = " + ".join([_dbl(LIN_B)] + [f"m_{c} * {_dbl(LIN_W[c])}" for c in LIN_F])
_PRED = " + ".join([_dbl(LIN_B)] + [f"{c} * {_dbl(LIN_W[c])}" for c in LIN_F])
CONTRIB = (SC + f", imp AS ({median_fill('scored', FX.LABS)}), m AS (SELECT "
           + ", ".join(f"avg({c}) AS m_{c}" for c in LIN_F) + " FROM imp), "
           "contrib AS (" + union([f"SELECT encounter_id, {_BASE} AS base_value, {_PRED} AS prediction, '{c}' AS feature, "
                                   f"CAST({c} AS DOUBLE) AS value, ({c} - m_{c}) * {_dbl(LIN_W[c])} AS contribution FROM imp, m"
                                   for c in LIN_F]) + ") ")

register("x01_linear_shapley", CONTRIB + "SELECT * FROM contrib",
         doubles=["base_value", "prediction", "value", "contribution"], family="attribution")(lambda s, d: XP.long(contributions(s, d)))

register("x02_base_value", CONTRIB + "SELECT DISTINCT base_value FROM contrib", doubles=["base_value"],
         family="attribution")(lambda s, d: contributions(s, d).select("base_value").distinct())

register("x03_additivity_check",
         CONTRIB + "SELECT count_if(abs(b + s - p) > 1e-9) AS n_violations, count(*) AS n_rows FROM (SELECT encounter_id, "
         "max(base_value) AS b, sum(contribution) AS s, max(prediction) AS p FROM contrib GROUP BY 1) t", family="attribution")(
    lambda s, d: contributions(s, d).select(
        F.col("base_value").alias("b"), F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["contribution"]).alias("s"),
        F.col("prediction").alias("p"))
    .agg(F.count_if(F.abs(F.col("b") + F.col("s") - F.col("p")) > 1e-9).alias("n_violations"),
         F.count(F.lit(1)).alias("n_rows")))

register("x04_a30_global_importance",
         CONTRIB + "SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM contrib GROUP BY 1",
         doubles=["mean_abs_contribution"], family="attribution")(lambda s, d: XP.global_importance(contributions(s, d)))


def _q_x5(s, d):
    c = contributions(s, d)
    size = F.round("mean_abs_contribution", 9)     # order-free float noise
    top = [r["feature"] for r in XP.global_importance(c).orderBy(F.desc(size), "feature").limit(3).collect()]     # 3 rows
    return XP.dependence(c, "encounter_id", top, top[0]).select("encounter_id", "feature", "value", "contribution",
                                                                "interaction_feature", "interaction_value")


register("x05_dependence_top3",
         CONTRIB + ", gi AS (SELECT feature, avg(abs(contribution)) AS a FROM contrib GROUP BY 1), "
         "top AS (SELECT feature FROM gi ORDER BY round(a, 9) DESC, feature LIMIT 3), first AS (SELECT feature AS "
         "interaction_feature FROM gi ORDER BY round(a, 9) DESC, feature LIMIT 1) SELECT c.encounter_id, c.feature, c.value, c.contribution, "
         "i.feature AS interaction_feature, i.value AS interaction_value FROM contrib c JOIN top USING (feature) "
         "JOIN contrib i ON i.encounter_id = c.encounter_id AND i.feature = (SELECT interaction_feature FROM first)",
         doubles=["value", "contribution", "interaction_value"], family="attribution")(_q_x5)

register("t2_top5_features_per_row",
         CONTRIB + "SELECT encounter_id, feature, contribution, rank, CASE WHEN contribution > 0 THEN 'Increases risk' ELSE "
         "'Decreases risk' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY "
         "abs(contribution) DESC, feature) AS rank FROM contrib) WHERE rank <= 5",
         doubles=["contribution"], family="attribution")(
    lambda s, d: XP.top_features(contributions(s, d), "encounter_id").select(
        "encounter_id", "feature", "contribution", "rank", "direction"))

register("w1_waterfall",
         CONTRIB + "SELECT encounter_id, feature, rank, base_value + sum(contribution) OVER (PARTITION BY encounter_id ORDER BY "
         "rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total FROM (SELECT *, row_number() OVER "
         "(PARTITION BY encounter_id ORDER BY abs(contribution) DESC, feature) AS rank FROM contrib) WHERE rank <= 10",
         doubles=["running_total"], family="windows")(
    lambda s, d: XP.waterfall(contributions(s, d), "encounter_id").select("encounter_id", "feature", "rank", "running_total"))

register("w9_percent_scaled_contributions",
         CONTRIB + "SELECT encounter_id, feature, least(CASE WHEN abs(contribution) > 0.001 THEN greatest(p, 5.0) ELSE p END, 100.0)"
         " AS value_percent FROM (SELECT *, abs(contribution) / NULLIF(max(abs(contribution)) OVER (PARTITION BY encounter_id), 0)"
         " * 100 AS p FROM contrib) t", doubles=["value_percent"], family="windows")(
    lambda s, d: XP.percent_scaled(contributions(s, d), "encounter_id").select("encounter_id", "feature", "value_percent"))


def _q_x6(s, d):
    r = XP.explanation_records(contributions(s, d), "encounter_id")
    return r.select("encounter_id", F.concat_ws(";", F.transform("explanation", lambda x: x["feature"])).alias("features"))


register("x06_explanation_records",
         CONTRIB + "SELECT encounter_id, string_agg(feature, ';' ORDER BY rank) AS features FROM (SELECT *, row_number() OVER "
         "(PARTITION BY encounter_id ORDER BY abs(contribution) DESC, feature) AS rank FROM contrib) WHERE rank <= 5 GROUP BY 1",
         family="attribution")(_q_x6)

# ---- windows / top-k ---------------------------------------------------------------


def last_n_per_key(df, key, ts, tie, n):
    """Newest n rows per key.  ``row_number() <= n`` lets Spark insert a
    per-task WindowGroupLimit before the shuffle, so a hot key ships at most
    n rows per task."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


register("w6_last_50_per_patient",
         ENC + "SELECT patient_id, encounter_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY "
         "seen_at DESC, encounter_id DESC) AS recency FROM encounters) WHERE recency <= 50", family="windows")(
    lambda s, d: last_n_per_key(FX.encounters(s, d), "patient_id", "seen_at", "encounter_id", 50)
    .select("patient_id", "encounter_id", "recency"))

FRACS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
register("w8_learning_curve_subsets",
         ENC + ", r AS (SELECT row_number() OVER (ORDER BY " + hash_key_sql("encounter_id") + ", encounter_id) AS rk, "
         "count(*) OVER () AS n FROM encounters), f AS (" + union([f"SELECT CAST({x} AS DOUBLE) AS fraction" for x in FRACS])
         + ") SELECT fraction, count(*) AS n FROM r, f WHERE rk <= ceil(n * fraction) GROUP BY 1",
         doubles=["fraction"], family="windows")(
    lambda s, d: growing_subsets(FX.encounters(s, d), "encounter_id", FRACS).groupBy("fraction")
    .agg(F.count(F.lit(1)).alias("n")))

T1 = FX.MODEL_FEATURES
register("t1_top10_target_correlations",
         SC + "SELECT * FROM (" + per_col(T1, "SELECT '{c}' AS \"column\", corr({c}, appendicitis) AS corr, "
                                          "abs(corr({c}, appendicitis)) AS abs_corr FROM scored")
         + ") t ORDER BY abs_corr DESC, \"column\" LIMIT 10", doubles=["corr", "abs_corr"], family="topk")(
    lambda s, d: PR.target_correlations(FX.scored_encounters(s, d), T1, "appendicitis").limit(10))

# ---- joins / sets ----------------------------------------------------------------------


def _detector_flags(e):
    out = {}
    for m in ["iqr", "zscore", "percentile"]:
        b = OU.fit_bounds(e, FX.CONTINUOUS, m, need_center=False)
        f = F.lit(False)
        for c in FX.CONTINUOUS:
            if c in b:
                f = f | OU.flag_expr(c, b[c], m)
        out[m] = f
    return out


def _q_j1(s, d):
    e = FX.encounters(s, d)
    fl = _detector_flags(e)
    return e.groupBy(fl["iqr"].alias("iqr"), fl["zscore"].alias("zscore"), fl["percentile"].alias("percentile")).agg(
        F.count(F.lit(1)).alias("n"))


def _flags_sql():
    ctes = []
    flags = {}
    for m in ["iqr", "zscore", "percentile"]:
        for c in FX.CONTINUOUS:
            ctes.append(f"{m}_{c} AS (SELECT lo_{c} AS {m}_lo_{c}, hi_{c} AS {m}_hi_{c}, m_{c} AS {m}_m_{c}, sd_{c} AS {m}_sd_{c} "
                        f"FROM ({_stats_cte(m, [c])}) x)")
        fs = []
        for c in FX.CONTINUOUS:
            f = _flag_sql(m, c).replace(f"lo_{c}", f"{m}_lo_{c}").replace(f"hi_{c}", f"{m}_hi_{c}") \
                .replace(f"m_{c}", f"{m}_m_{c}").replace(f"sd_{c}", f"{m}_sd_{c}")
            fs.append(f)
        flags[m] = "(" + " OR ".join(fs) + ")"
    joined = "encounters" + "".join(f", {m}_{c}" for m in ["iqr", "zscore", "percentile"] for c in FX.CONTINUOUS)
    return ENC + ", " + ", ".join(ctes) + " ", flags, joined


_FS, _FL, _FJ = _flags_sql()
register("j01_detector_mask_combination",
         _FS + f"SELECT {_FL['iqr']} AS iqr, {_FL['zscore']} AS zscore, {_FL['percentile']} AS percentile, count(*) AS n "
         f"FROM {_FJ} GROUP BY 1, 2, 3", family="joins")(_q_j1)


def _q_j2(s, d):
    e = FX.encounters(s, d)
    ids = e.where(_detector_flags(e)["iqr"]).select("encounter_id")
    return e.join(ids, "encounter_id", "left_anti").select("encounter_id")


register("j02_anti_join_outlier_ids",
         _FS + f"SELECT encounter_id FROM encounters WHERE encounter_id NOT IN (SELECT encounter_id FROM {_FJ} WHERE {_FL['iqr']})",
         family="joins")(_q_j2)


def _q_u3(s, d):
    e = FX.encounters(s, d)
    fl = _detector_flags(e)
    a = e.where(fl["iqr"]).select("encounter_id")
    b = e.where(fl["percentile"]).select("encounter_id")
    return a.union(b).distinct()


register("u03_union_outlier_ids",
         _FS + f"SELECT encounter_id FROM {_FJ} WHERE {_FL['iqr']} UNION SELECT encounter_id FROM {_FJ} WHERE {_FL['percentile']}",
         family="sets")(_q_u3)


def _q_j3(s, d):
    e = FX.encounters(s, d)
    st = OU.fit_reference_stats(e, FX.CONTINUOUS)          # (column, mean, sd): one row per column
    long = stack_long(e, FX.CONTINUOUS, keep=["encounter_id"])
    j = long.join(F.broadcast(st), "column")
    return j.groupBy("column").agg(F.count_if(F.abs((F.col("value") - F.col("mean")) / F.col("sd")) > 3).alias("n_outliers"))


register("j03_params_broadcast_join",
         ENC + per_col(FX.CONTINUOUS, "SELECT '{c}' AS \"column\", count_if(abs(({c} - (SELECT avg({c}) FROM encounters)) / "
                       "(SELECT stddev_samp({c}) FROM encounters)) > 3) AS n_outliers FROM encounters"), family="joins")(_q_j3)

# Fixed linear scorers for the model × case join (logit-space weights).
J4_MODELS = {"logit": (LIN_W, LIN_B),
             "scores_only": ({"pediatric_appendicitis_score": 0.03, "alvarado_score": 0.03}, -0.5)}


def _q_j4(s, d):
    e = _imp(s, d)
    scores = []
    for m, (ws, b) in J4_MODELS.items():
        z = sum((F.col(f).cast("double") * float(w) for f, w in ws.items()), F.lit(0.0))
        scores.append(F.struct(F.lit(m).alias("model"), SF.sigmoid(z + F.lit(float(b))).alias("score")))
    return e.select("encounter_id", F.inline(F.array(*scores)))     # every model on its row: no shuffle


def _j4_sql():
    parts = []
    for m, (ws, b) in J4_MODELS.items():
        z = " + ".join(f"{c} * {_dbl(float(w))}" for c, w in ws.items())
        parts.append(f"SELECT '{m}' AS model, encounter_id, 1.0 / (1.0 + exp(-(({z}) + {_dbl(float(b))}))) AS score FROM imp")
    return SC + f", imp AS ({median_fill('scored', FX.LABS)}) " + union(parts)


register("j04_models_x_cases", _j4_sql(), doubles=["score"], family="joins")(_q_j4)

register("u02_repeat_frame",
         ENC + "SELECT rep, count(*) AS n, sum(encounter_id) AS id_sum FROM encounters, range(0, 3) t(rep) GROUP BY 1",
         family="sets")(
    lambda s, d: FX.encounters(s, d).crossJoin(s.range(0, 3).withColumnRenamed("id", "rep"))
    .groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.sum("encounter_id").alias("id_sum")))

# ---- scalar functions ------------------------------------------------------------------

register("f01_to_number",
         FBV + "SELECT report_id, TRY_CAST(diagnostic_accuracy AS DOUBLE) AS accuracy FROM feedback",
         doubles=["accuracy"], family="functions")(
    lambda s, d: fb(s, d).select("report_id", SF.to_number("diagnostic_accuracy").alias("accuracy")))

register("f02_fill_constant", ENC + "SELECT encounter_id, coalesce(white_blood_cell_count, 0) AS wbc FROM encounters",
         doubles=["wbc"], family="functions")(
    lambda s, d: FX.encounters(s, d).select("encounter_id", SF.fill_const("white_blood_cell_count", 0.0).alias("wbc")))

register("f03_label_to_int",
         FBV + "SELECT report_id, CAST(lower(coalesce(actual_diagnosis, 'Unknown')) = 'appendicite' AS INTEGER) AS y FROM feedback",
         family="functions")(
    lambda s, d: fb(s, d).select("report_id", SF.label_to_int("actual_diagnosis", "appendicite").alias("y")))

register("f04_clip",
         ENC + "SELECT encounter_id, CASE WHEN c_reactive_protein IS NULL THEN NULL ELSE least(greatest(c_reactive_protein, 0), 300) "
         "END AS crp FROM encounters", doubles=["crp"], family="functions")(
    lambda s, d: FX.encounters(s, d).select("encounter_id", SF.clip("c_reactive_protein", 0.0, 300.0).alias("crp")))


def _q_f5(s, d):
    ev = read_table(s, d, "events")
    st = ev.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return ev.crossJoin(F.broadcast(st)).select("event_id", SF.zscore("value", F.col("m"), F.col("sd")).alias("z"))


register("f05_zscore",
         "SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events",
         doubles=["z"], family="functions")(_q_f5)

register("f06_cut_right_closed",
         ENC + f"SELECT encounter_id, {SF.cut_sql('duration', *SF.PAIN_BINS)} AS pain_bin FROM encounters",
         family="functions")(
    lambda s, d: FX.encounters(s, d).select("encounter_id", SF.cut("duration", *SF.PAIN_BINS).alias("pain_bin")))

_P = "least(greatest(alvarado_score / 10.0, 0.05), 0.95)"


def _q_f7(s, d):
    e = FE.rule_score(FX.scored_encounters(s, d))
    return e.select("encounter_id", *[SF.risk_band("rule_probability", r).alias(f"band_{r}")
                                      for r in ["app", "demo", "integration"]],
                    SF.risk_band("rule_probability", SF.threshold_rule(0.5)).alias("band_threshold"))


register("f07_risk_bands",
         SC + f"SELECT encounter_id, {SF.risk_band_sql(_P, 'app')} AS band_app, {SF.risk_band_sql(_P, 'demo')} AS band_demo, "
         f"{SF.risk_band_sql(_P, 'integration')} AS band_integration, {SF.risk_band_sql(_P, SF.threshold_rule(0.5))} "
         "AS band_threshold FROM scored", family="functions")(_q_f7)


def _q_f8(s, d):
    e = FE.rule_score(FX.scored_encounters(s, d)).select("encounter_id", "rule_probability")
    bands = s.createDataFrame(SF.RECOMMENDATIONS, "lo double, hi double, risk string, recommendation string")
    j = e.join(F.broadcast(bands), (e["rule_probability"] >= bands["lo"]) & (e["rule_probability"] < bands["hi"]))
    return j.select("encounter_id", "risk", "recommendation")


register("f08_recommendation_band_join",
         SC + ", b AS (" + union([f"SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, '{r}' AS risk, '{t}' AS "
                                  "recommendation" for lo, hi, r, t in SF.RECOMMENDATIONS])
         + f") SELECT encounter_id, risk, recommendation FROM scored JOIN b ON {_P} >= b.lo AND {_P} < b.hi",
         family="functions")(_q_f8)

register("f09_number_format",
         SC + f"SELECT encounter_id, printf('%.1f', {_P} * 100) || '%' AS pct_text, printf('%.4f', {_P}) AS p4 FROM scored",
         family="functions")(
    lambda s, d: FE.rule_score(FX.scored_encounters(s, d)).select(
        "encounter_id", SF.pct_text("rule_probability").alias("pct_text"),
        F.format_string("%.4f", "rule_probability").alias("p4")))

register("f10_display_names",
         SC + f", c AS ({union([f'SELECT encounter_id, {chr(39)}{f}{chr(39)} AS feature FROM scored' for f, _ in FE.RULE_CONTRIBUTIONS])}) "
         f"SELECT encounter_id, feature, {SF.display_name_sql('feature')} AS display_name FROM c", family="functions")(
    lambda s, d: FE.rule_contributions(FX.scored_encounters(s, d), "encounter_id").select(
        "encounter_id", "feature", SF.display_name("feature").alias("display_name")))

F11 = ["gender", "migration", "fever", "age"]


def _q_f11(s, d):
    long = stack_long(FX.encounters(s, d), F11, keep=["encounter_id"], name_col="feature")
    return long.select("encounter_id", "feature", SF.display_value("feature", "value").alias("display"))


register("f11_display_values",
         ENC + union([f"SELECT encounter_id, '{c}' AS feature, CASE WHEN {c} IS NULL THEN 'N/A' "
                      + ("WHEN CAST(gender AS INTEGER) = 1 THEN 'Male' ELSE 'Female' END" if c == "gender" else
                         f"WHEN CAST({c} AS INTEGER) = 1 THEN 'Yes' ELSE 'No' END" if c in SF.BOOLEAN_FEATURES else
                         f"ELSE CAST(CAST({c} AS DOUBLE) AS VARCHAR) END")
                      + " AS display FROM encounters" for c in F11]), family="functions")(_q_f11)


def _bytes_sql(x):
    parts = []
    for i, u in enumerate(SF.BYTE_UNITS):
        parts.append(f"WHEN {x} < {1024.0 ** (i + 1)} THEN printf('%.2f', round({x} / {1024.0 ** i}, 2)) || ' {u}'")
    return "CASE " + " ".join(parts) + f" ELSE printf('%.2f', round({x} / {1024.0 ** 5}, 2)) || ' PB' END"


register("f12_human_bytes",
         f"SELECT page_id, {_bytes_sql('CAST(strlen(html) AS DOUBLE)')} AS size_text FROM pages", family="functions")(
    lambda s, d: read_table(s, d, "pages").select("page_id", SF.human_bytes(F.octet_length("html")).alias("size_text")))

register("f13_report_id_timestamp",
         ENC + "SELECT encounter_id, 'APX-' || CAST(CAST(floor(epoch(seen_at)) AS BIGINT) AS VARCHAR) AS report_id, "
         "strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_text FROM encounters", family="functions")(
    lambda s, d: FX.encounters(s, d).select("encounter_id", SF.report_id("seen_at").alias("report_id"),
                                            F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_text")))

register("f15_math",
         "SELECT event_id, 1.0 / (1.0 + exp(-(value / 100.0))) AS sig, ln(value + 1.0) AS logv, pow(value, 2) AS sq, "
         "abs(value - 50.0) AS dev, least(value, 100.0) AS capped FROM events",
         doubles=["sig", "logv", "sq", "dev", "capped"], family="functions")(
    lambda s, d: read_table(s, d, "events").select(
        "event_id", SF.sigmoid(F.col("value") / 100.0).alias("sig"), F.log(F.col("value") + 1.0).alias("logv"),
        F.pow("value", 2).alias("sq"), F.abs(F.col("value") - 50.0).alias("dev"),
        F.least(F.col("value"), F.lit(100.0)).alias("capped")))

register("f17_json_field",
         "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", family="functions")(
    lambda s, d: read_table(s, d, "events").select("event_id", SF.json_int("props", "$.k").alias("k")))
