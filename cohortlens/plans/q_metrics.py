"""Model-evaluation queries over three transparent scorers of the
encounters (rule E9, logit E12, weak label E11) — SQL-expressible, so every
metric has an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import risk_band, risk_band_sql, threshold_rule
from ..operators import features as FE
from ..operators import metrics as ME
from ..operators.missing import impute
from ..operators.profile import crosstab
from ..operators.split import split_sql_expr, train_test_split
from . import fixtures as FX
from .registry import register
from .sqlgen import median_fill

MODELS = ["rule", "logit", "weak"]


def wide_scores(s, d):
    """(encounter_id, label, rule, logit, weak): every scorer on its row."""
    e = impute(FX.scored_encounters(s, d), "median", cols=FX.LABS)
    w = FE.weak_label(e)
    return w.select("encounter_id", F.col("appendicitis").alias("label"),
                    FE.rule_probability().alias("rule"), FE.logit_probability().alias("logit"),
                    F.col("weak_score").alias("weak"))


def model_scores(s, d):
    """(encounter_id, label, model, score, pred) for the three scorers."""
    long = wide_scores(s, d).select("encounter_id", "label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in MODELS])))
    return long.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def _weak_sql():
    t = []
    for c, w, thr in FE.WEAK_LABEL_WEIGHTS:
        t.append(f"coalesce({c}, 0) * CAST({w} AS DOUBLE)" if thr is None
                 else f"CAST(coalesce({c} > {thr}, false) AS INTEGER) * CAST({w} AS DOUBLE)")
    return " + ".join(t)


def _logit_sql():
    t = [f"(({c} - CAST({s} AS DOUBLE)) / CAST({d} AS DOUBLE)) * CAST({w} AS DOUBLE)" for c, w, s, d in FE.LOGIT_TERMS]
    return "1.0 / (1.0 + exp(-(" + " + ".join(t) + f" + CAST({FE.LOGIT_OFFSET} AS DOUBLE))))"


MS = (FX.with_views("scored") + f", imp AS ({median_fill('scored', FX.LABS)}), "
      f"w AS (SELECT *, {_weak_sql()} AS wr FROM imp), "
      f"base AS (SELECT encounter_id, appendicitis AS label, least(greatest(alvarado_score / 10.0, 0.05), 0.95) AS rule, "
      f"{_logit_sql()} AS logit, wr / (SELECT max(wr) FROM w) AS weak FROM w), "
      "ms0 AS (" + " UNION ALL ".join(f"SELECT encounter_id, label, '{m}' AS model, CAST({m} AS DOUBLE) AS score FROM base"
                                      for m in MODELS) + "), "
      "ms AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM ms0) ")

CM_SQL = ("SELECT model, count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp, "
          "count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp FROM ms GROUP BY model")


def _z(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


RATES = (f"{_z('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_z('tp', 'tp + fp')} AS precision, "
         f"{_z('tp', 'tp + fn')} AS recall")
F1 = f"{_z('2 * precision * recall', 'precision + recall')} AS f1"
AUC_SQL = ("SELECT model, (sum(CASE WHEN label = 1 THEN mr ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / "
           "(sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT model, label, "
           "rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS mr "
           "FROM ms) r GROUP BY model")
EVAL_SQL = (f"cm AS ({CM_SQL}), r AS (SELECT model, {RATES} FROM cm), r2 AS (SELECT *, {F1} FROM r), "
            f"a AS ({AUC_SQL}), ev AS (SELECT r2.*, a.auc FROM r2 JOIN a USING (model)) ")

register("a17_confusion_per_model", MS + CM_SQL, family="metrics")(
    lambda s, d: ME.confusion(model_scores(s, d), by=["model"]))

register("m11_evaluate_models", MS + ", " + EVAL_SQL + "SELECT * FROM ev",
         doubles=["accuracy", "precision", "recall", "f1", "auc"], family="metrics")(
    lambda s, d: ME.evaluate(model_scores(s, d), by=["model"]))

register("w4_auc_rank_sum", MS + AUC_SQL, doubles=["auc"], family="metrics")(
    lambda s, d: ME.auc(model_scores(s, d), by=["model"]))


def _clin_sql():
    sens, spec = "CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0)", "CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)"
    return (MS + f", cm AS ({CM_SQL}) SELECT *, {sens} AS sensitivity, {spec} AS specificity, "
            "CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS ppv, CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0) AS npv, "
            "CAST(tp AS DOUBLE) * tn / NULLIF(CAST(fp AS DOUBLE) * fn, 0) AS dor, "
            f"({sens}) / NULLIF(1 - ({spec}), 0) AS lr_pos, (1 - ({sens})) / NULLIF({spec}, 0) AS lr_neg FROM cm")


register("m12_clinical_metrics", _clin_sql(),
         doubles=["sensitivity", "specificity", "ppv", "npv", "dor", "lr_pos", "lr_neg"], family="metrics")(
    lambda s, d: ME.clinical_metrics(ME.confusion(model_scores(s, d), by=["model"])))


def _report_sql():
    per = []
    for cls, (t, fp_, fn_, sup) in {"0": ("tn", "fn", "fp", "tn + fp"), "1": ("tp", "fp", "fn", "tp + fn")}.items():
        per.append(f"SELECT model, '{cls}' AS class, {_z(t, t + ' + ' + fp_)} AS precision, {_z(t, t + ' + ' + fn_)} AS recall, "
                   f"CAST({sup} AS BIGINT) AS support FROM cm")
    per_sql = " UNION ALL ".join(per)
    return (MS + f", cm AS ({CM_SQL}), p0 AS ({per_sql}), per AS (SELECT model, class, precision, recall, "
            f"{_z('2 * precision * recall', 'precision + recall')} AS f1, support FROM p0) "
            "SELECT * FROM per UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), "
            "CAST(sum(support) AS BIGINT) FROM per GROUP BY model UNION ALL SELECT model, 'weighted avg', "
            "sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), "
            "CAST(sum(support) AS BIGINT) FROM per GROUP BY model")


register("m13_classification_report", _report_sql(), doubles=["precision", "recall", "f1"], family="metrics")(
    lambda s, d: ME.classification_report(model_scores(s, d), by=["model"]))

PTS_SQL = ("g AS (SELECT model, score AS threshold, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM ms "
           "GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) "
           "AS P, sum(neg) OVER (PARTITION BY model) AS N FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
           f"pts AS (SELECT model, threshold, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {_z('tp', 'P')} AS tpr, "
           f"{_z('fp', 'N')} AS fpr, {_z('tp', 'tp + fp')} AS precision, {_z('tp', 'P')} AS recall, CAST(P AS BIGINT) AS P, "
           "CAST(N AS BIGINT) AS N FROM c) ")

register("w2_w3_roc_pr_points", MS + ", " + PTS_SQL + "SELECT * FROM pts",
         doubles=["threshold", "tpr", "fpr", "precision", "recall"], family="metrics")(
    lambda s, d: ME.roc_pr_points(model_scores(s, d), by=["model"]))

register("m14_curve_areas",
         MS + ", " + PTS_SQL + "SELECT model, sum((CAST(neg AS DOUBLE) / N) * ((tp - pos) / CAST(P AS DOUBLE) + tp / "
         "CAST(P AS DOUBLE)) / 2) AS roc_auc, sum((CAST(pos AS DOUBLE) / P) * (precision + CASE WHEN tp - pos + fp - neg = 0 "
         "THEN 1.0 ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END) / 2) AS pr_auc, "
         "sum((CAST(pos AS DOUBLE) / P) * precision) AS average_precision FROM pts GROUP BY model",
         doubles=["roc_auc", "pr_auc", "average_precision"], family="metrics")(
    lambda s, d: ME.curve_areas(ME.roc_pr_points(model_scores(s, d), by=["model"]), by=["model"]))

register("m15_log_loss_brier",
         MS + "SELECT model, avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * "
         "ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss, avg((score - label) * (score - label)) AS brier "
         "FROM ms GROUP BY model", doubles=["log_loss", "brier"], family="metrics")(
    lambda s, d: ME.loss_scores(model_scores(s, d), by=["model"]))

SWEEP_SQL = ("th AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold FROM range(0, 101) t(k)), "
             "tot AS (SELECT model, count_if(label = 1) AS P, count_if(label = 0) AS N FROM ms GROUP BY 1), "
             "sw0 AS (SELECT ms.model, th.threshold, count_if(ms.label = 1 AND ms.score >= th.threshold) AS tp, "
             "count_if(ms.label = 0 AND ms.score >= th.threshold) AS fp FROM ms, th GROUP BY 1, 2), "
             "sw1 AS (SELECT sw0.model, threshold, tp, fp, N - fp AS tn, P - tp AS fn, P, N FROM sw0 JOIN tot USING (model)), "
             f"sw AS (SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, "
             f"CAST(fn AS BIGINT) AS fn, {_z('tp', 'tp + fn')} AS sensitivity, {_z('tn', 'tn + fp')} AS specificity, "
             f"{_z('tp', 'tp + fp')} AS ppv, {_z('tn', 'tn + fn')} AS npv, {_z('tp + tn', 'P + N')} AS accuracy, "
             f"{_z('2 * (' + _z('tp', 'tp + fp') + ') * (' + _z('tp', 'tp + fn') + ')', '(' + _z('tp', 'tp + fp') + ') + (' + _z('tp', 'tp + fn') + ')')} AS f1 "
             "FROM sw1 WHERE tp + fp > 0 AND tn + fn > 0) ")

register("m16_threshold_sweep", MS + ", " + SWEEP_SQL + "SELECT * FROM sw",
         doubles=["threshold", "sensitivity", "specificity", "ppv", "npv", "accuracy", "f1"], family="thresholds")(
    lambda s, d: ME.threshold_sweep(model_scores(s, d), by=["model"]))

register("m17_optimal_thresholds",
         MS + ", " + SWEEP_SQL + ", crit AS (" + " UNION ALL ".join(
             f"SELECT model, threshold, {e} AS value, '{n}' AS criterion FROM sw" for n, e in [
                 ("f1", "f1"), ("accuracy", "accuracy"), ("youden", "sensitivity + specificity - 1"),
                 ("sens2_spec", "2 * sensitivity + specificity")])
         + ") SELECT model, threshold, value, criterion FROM (SELECT *, row_number() OVER (PARTITION BY model, criterion "
         "ORDER BY value DESC, threshold) AS r FROM crit) WHERE r = 1",
         doubles=["threshold", "value"], family="thresholds")(
    lambda s, d: ME.optimal_thresholds(ME.threshold_sweep(model_scores(s, d), by=["model"]), by=["model"]))

NAMES = ["accuracy", "precision", "recall", "f1", "auc"]
COMP = "0.15 * accuracy + 0.20 * precision + 0.20 * recall + 0.25 * f1 + 0.20 * auc"
register("m18_composite_best_per_metric",
         MS + ", " + EVAL_SQL + f", ev2 AS (SELECT *, {COMP} AS composite FROM ev), long AS (" + " UNION ALL ".join(
             f"SELECT model, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM ev2" for n in NAMES + ["composite"])
         + ") SELECT model, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model)"
         " AS r FROM long) WHERE r = 1", doubles=["value"], family="metrics")(
    lambda s, d: ME.best_per_metric(ME.composite_score(ME.evaluate(model_scores(s, d), by=["model"])), "model",
                                    NAMES + ["composite"]))

register("m20_metric_long_table",
         MS + ", " + EVAL_SQL + " " + " UNION ALL ".join(
             f"SELECT model, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM ev" for n in NAMES),
         doubles=["value"], family="metrics")(
    lambda s, d: ME.metric_long(ME.evaluate(model_scores(s, d), by=["model"]), "model", NAMES))

register("c3_calibration_curve",
         MS + "SELECT model, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, avg(score) AS mean_predicted, "
         "avg(CAST(label AS DOUBLE)) AS fraction_positive, count(*) AS n FROM ms GROUP BY 1, 2",
         doubles=["mean_predicted", "fraction_positive"], family="calibration")(
    lambda s, d: ME.calibration_curve(model_scores(s, d), by=["model"]))


def _q_a18(s, d):
    ms = model_scores(s, d)
    out = ms.select("model", "encounter_id", F.when((F.col("label") == 1) & (F.col("pred") == 1), "tp")
                    .when((F.col("label") == 0) & (F.col("pred") == 0), "tn")
                    .when(F.col("pred") == 1, "fp").otherwise("fn").alias("outcome"))
    return out.groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n"))


register("a18_outcomes_per_model",
         MS + "SELECT model, CASE WHEN label = 1 AND pred = 1 THEN 'tp' WHEN label = 0 AND pred = 0 THEN 'tn' "
         "WHEN pred = 1 THEN 'fp' ELSE 'fn' END AS outcome, count(*) AS n FROM ms GROUP BY 1, 2", family="metrics")(_q_a18)

register("a28_discrimination_power",
         MS + "SELECT model, avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0) AS discrimination "
         "FROM ms GROUP BY model", doubles=["discrimination"], family="metrics")(
    lambda s, d: model_scores(s, d).groupBy("model").agg(
        (F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score"))))
        .alias("discrimination")))


register("a29_score_difference",
         MS + ", wide AS (SELECT encounter_id, max(score) FILTER (WHERE model = 'rule') AS rule, "
         "max(score) FILTER (WHERE model = 'logit') AS logit FROM ms GROUP BY 1) "
         "SELECT avg(abs(rule - logit)) AS mean_abs_diff, max(abs(rule - logit)) AS max_abs_diff FROM wide",
         doubles=["mean_abs_diff", "max_abs_diff"], family="metrics")(
    lambda s, d: wide_scores(s, d).agg(F.avg(F.abs(F.col("rule") - F.col("logit"))).alias("mean_abs_diff"),
                                 F.max(F.abs(F.col("rule") - F.col("logit"))).alias("max_abs_diff")))

register("t3_top5_score_difference",
         MS + ", wide AS (SELECT encounter_id, max(score) FILTER (WHERE model = 'rule') AS rule, "
         "max(score) FILTER (WHERE model = 'logit') AS logit FROM ms GROUP BY 1) "
         "SELECT encounter_id, abs(rule - logit) AS diff FROM wide ORDER BY diff DESC, encounter_id LIMIT 5",
         doubles=["diff"], family="topk")(
    lambda s, d: wide_scores(s, d).select("encounter_id", F.abs(F.col("rule") - F.col("logit")).alias("diff"))
    .orderBy(F.desc("diff"), "encounter_id").limit(5))

register("t6_challenging_cases",
         MS + "SELECT encounter_id, CAST(count_if(pred <> label) AS BIGINT) AS n_models_wrong FROM ms GROUP BY 1 "
         "HAVING bool_or(pred <> label)", family="topk")(
    lambda s, d: wide_scores(s, d).select("encounter_id", sum(
        [((F.col(m) > 0.5).cast("int") != F.col("label")).cast("bigint") for m in MODELS], F.lit(0).cast("bigint")).alias("n_models_wrong"))
    .where("n_models_wrong > 0"))

register("t5_models_by_auc", MS + ", " + EVAL_SQL + "SELECT model, auc FROM ev ORDER BY auc DESC, model",
         doubles=["auc"], family="topk")(
    lambda s, d: ME.evaluate(model_scores(s, d), by=["model"]).select("model", "auc").orderBy(F.desc("auc"), "model"))


def _q_m21(s, d):
    ev = ME.evaluate(model_scores(s, d), by=["model"])
    old = ev.where("model = 'rule'").select(F.col("auc").alias("old_auc"))
    new = ev.where("model = 'logit'").select(F.col("auc").alias("new_auc"))
    return old.crossJoin(new).select("old_auc", "new_auc", (F.col("new_auc") - F.col("old_auc")).alias("delta"),
                                     (F.col("new_auc") > F.col("old_auc")).alias("promote"))


register("m21_promotion_on_auc",
         MS + ", a AS (" + AUC_SQL + ") SELECT o.auc AS old_auc, n.auc AS new_auc, n.auc - o.auc AS delta, "
         "n.auc > o.auc AS promote FROM a o, a n WHERE o.model = 'rule' AND n.model = 'logit'",
         doubles=["old_auc", "new_auc", "delta"], family="metrics")(_q_m21)


def _q_m24(s, d):
    ms = model_scores(s, d).where("model = 'logit'")
    b = ms.withColumn("band", risk_band("score", threshold_rule(0.5)))
    return crosstab(b, "band", "label", [0, 1])


register("m24_decision_simulation",
         MS + f"SELECT {risk_band_sql('score', threshold_rule(0.5))} AS band, count_if(label = 0) AS n_0, "
         "count_if(label = 1) AS n_1, count(*) AS n, count_if(label = 1) * 100.0 / count(*) AS pct_1 FROM ms "
         "WHERE model = 'logit' GROUP BY 1", doubles=["pct_1"], family="thresholds")(_q_m24)


def _q_c4(s, d):
    """Bin rates of the training rows recalibrate the held-out rows; a bin without training rows keeps its score."""
    ms = train_test_split(model_scores(s, d).where("model = 'rule'"), "encounter_id")
    # recalibrated score: per-bin observed rate of the calibration curve (histogram binning, ten bins)
    cc = ME.calibration_curve(ms.where("split = 'train'")).select("bin", F.col("fraction_positive").alias("cal"))
    te = ms.where("split = 'test'").withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int"))
    b = te.join(F.broadcast(cc), "bin", "left").withColumn("cal", F.coalesce("cal", "score"))
    y = F.col("label").cast("double")
    return b.agg(F.avg((F.col("score") - y) ** 2).alias("brier_before"), F.avg((F.col("cal") - y) ** 2).alias("brier_after")).select(
        "*", ((F.col("brier_before") - F.col("brier_after")) / F.col("brier_before") * 100).alias("improvement_pct"))


register("c4_calibration_before_after",
         MS + f", r AS (SELECT *, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, {split_sql_expr('encounter_id')} AS split FROM ms WHERE model = 'rule'), "
         "cc AS (SELECT bin, avg(CAST(label AS DOUBLE)) AS cal FROM r WHERE split = 'train' GROUP BY 1), "
         "b AS (SELECT r.score, r.label, coalesce(cc.cal, r.score) AS cal FROM r LEFT JOIN cc ON cc.bin = r.bin WHERE r.split = 'test'), "
         "x AS (SELECT avg((score - label) * (score - label)) AS "
         "brier_before, avg((cal - label) * (cal - label)) AS brier_after FROM b) "
         "SELECT brier_before, brier_after, (brier_before - brier_after) / brier_before * 100 AS improvement_pct FROM x",
         doubles=["brier_before", "brier_after", "improvement_pct"], family="calibration")(_q_c4)


# ---- second score family: document quality (labels ⋈ documents) -------------------

def doc_model(s, d):
    ds = FX.doc_scores(s, d)
    return ds.select("doc_id", "lang", F.col("quality").alias("label"), "score",
                     (F.col("score") > 0.5).cast("int").alias("pred"))


DS = FX.with_views("doc_scores") + ", ms AS (SELECT doc_id, lang, quality AS label, score, " \
                                   "CAST(score > 0.5 AS INTEGER) AS pred FROM doc_scores) "
_CM_L = ("SELECT lang AS model, count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp, "
         "count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp FROM ms GROUP BY lang")
_AUC_L = ("SELECT model, (sum(CASE WHEN label = 1 THEN mr ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / "
          "NULLIF(sum(label) * (count(*) - sum(label)), 0) AS auc FROM (SELECT lang AS model, label, rank() OVER "
          "(PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS mr FROM ms) r "
          "GROUP BY model")


def _q_doc_eval(s, d):
    ev = ME.evaluate(doc_model(s, d), by=["lang"])
    return ev.withColumnRenamed("lang", "model")


register("m11_doc_quality_by_language",
         DS + f", cm AS ({_CM_L}), r AS (SELECT model, {RATES} FROM cm), r2 AS (SELECT *, {F1} FROM r), a AS ({_AUC_L}) "
         "SELECT r2.*, a.auc FROM r2 JOIN a USING (model)",
         doubles=["accuracy", "precision", "recall", "f1", "auc"], family="metrics")(_q_doc_eval)

register("c3_doc_quality_calibration",
         DS + "SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, avg(score) AS mean_predicted, "
         "avg(CAST(label AS DOUBLE)) AS fraction_positive, count(*) AS n FROM ms GROUP BY 1",
         doubles=["mean_predicted", "fraction_positive"], family="calibration")(
    lambda s, d: ME.calibration_curve(doc_model(s, d)))



def _q_t4(s, d):
    ms = model_scores(s, d)
    ev = ME.evaluate(ms, by=["model"]).join(ME.loss_scores(ms, by=["model"]), "model")
    return ME.best_per_metric(ev, "model", NAMES + ["log_loss", "brier"], lower_is_better=["log_loss", "brier"])


register("t4_best_model_per_metric",
         MS + ", " + EVAL_SQL + ", ls AS (SELECT model, avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + "
         "(1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss, avg((score - label) * "
         "(score - label)) AS brier FROM ms GROUP BY model), e2 AS (SELECT * FROM ev JOIN ls USING (model)), long AS ("
         + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM e2"
                              for n in NAMES + ["log_loss", "brier"])
         + ") SELECT model, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN "
         "metric IN ('log_loss', 'brier') THEN -value ELSE value END DESC, model) AS r FROM long) WHERE r = 1",
         doubles=["value"], family="topk")(_q_t4)
