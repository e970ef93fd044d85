"""Binary-classification metrics over scored tables (A17, A18, W2-W4,
M11-M18, M20, M24, C3-C4).

Input is a long score table ``(by..., label, score[, pred])``.  Everything
is an aggregate or a distributed prefix sum over *distinct* scores; no
window ever spans the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import mid_ranks, running_sum

EPS = 1e-15


def _div(a: Column, b: Column) -> Column:
    """Zero denominators -> 0 (sklearn's zero_division behaviour)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | tuple = ()) -> DataFrame:
    """Tn fp fn tp (per group)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def with_rates(cm: DataFrame) -> DataFrame:
    """accuracy precision recall f1 (+ specificity, npv) from tn fp fn tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return cm.select("*", _div(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
                     rec.alias("recall"), _div(2 * prec * rec, prec + rec).alias("f1"))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = ()) -> DataFrame:
    """W4 + M11: ROC AUC by the Mann-Whitney rank sum with mid-ranks (ties
    count 1/2), distributed over distinct scores."""
    by = list(by)
    d = df.select(*by, F.col(score).alias("_s"), F.col(label).cast("long").alias("_pos"))
    r = mid_ranks(d, "_s", by, ["_pos"])
    g = r.groupBy(*by).agg(F.sum(F.col("mid_rank") * F.col("_pos")).alias("_rsum"),
                           F.sum("_pos").alias("_P"), F.sum("cnt").alias("_n"))
    N = F.col("_n") - F.col("_P")
    a = F.try_divide(F.col("_rsum") - F.col("_P") * (F.col("_P") + 1) / 2.0, F.col("_P") * N)
    return g.select(*by, a.alias("auc"))


def evaluate(df: DataFrame, label: str = "label", pred: str = "pred", score: str = "score",
             by: list[str] | tuple = ()) -> DataFrame:
    """Accuracy, precision, recall, f1, auc per group."""
    m = with_rates(confusion(df, label, pred, by)).drop("tn", "fp", "fn", "tp")
    a = auc(df, label, score, by)
    return m.join(a, list(by)) if by else m.crossJoin(a)


def clinical_metrics(cm: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV, NPV, DOR, LR+, LR-."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return cm.select("*", sens.alias("sensitivity"), spec.alias("specificity"), F.try_divide(tp, tp + fp).alias("ppv"),
                     F.try_divide(tn, tn + fn).alias("npv"), F.try_divide(tp * tn, fp * fn).alias("dor"),
                     F.try_divide(sens, 1 - spec).alias("lr_pos"), F.try_divide(1 - sens, spec).alias("lr_neg"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | tuple = ()) -> DataFrame:
    """Per class precision/recall/f1/support, macro avg, weighted avg."""
    cm = confusion(df, label, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = []
    for cls, (t, f_p, f_n, sup) in {"0": (tn, fn, fp, tn + fp), "1": (tp, fp, fn, tp + fn)}.items():
        p, r = _div(t, t + f_p), _div(t, t + f_n)
        rows.append(cm.select(*by, F.lit(cls).alias("class"), p.alias("precision"), r.alias("recall"),
                              _div(2 * p * r, p + r).alias("f1"), sup.cast("bigint").alias("support")))
    per = rows[0].unionByName(rows[1])
    agg = per.groupBy(*by).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"), F.sum("support").alias("n"))
    macro = agg.select(*by, F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    weighted = agg.select(*by, F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def roc_pr_points(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = ()) -> DataFrame:
    """One point per distinct score (descending): cumulative tp/fp,
    tpr, fpr, precision, recall."""
    by = list(by)
    g = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    r = running_sum(g, "threshold", ["pos", "neg"], by, descending=True)
    tot = g.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = r.join(F.broadcast(tot), by) if by else r.crossJoin(F.broadcast(tot))
    return r.select(*by, "threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    _div(F.col("cum_pos"), F.col("P")).alias("tpr"), _div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    _div(F.col("cum_pos"), F.col("P")).alias("recall"), "P", "N")


def curve_areas(points: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """ROC AUC (trapezoid), PR AUC (trapezoid from (0,1)), average
    precision (step).  Each point's predecessor is derived from its own
    cumulative counts, so no ordered window is needed."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    prev_tp, prev_fp = tp - pos, fp - neg
    prev_prec = F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(prev_tp / (prev_tp + prev_fp))
    d_rec = pos / F.col("P")
    d_fpr = neg / F.col("N")
    roc = d_fpr * (prev_tp / F.col("P") + tp / F.col("P")) / 2
    return points.groupBy(*by).agg(F.sum(roc).alias("roc_auc"),
                                   F.sum(d_rec * (F.col("precision") + prev_prec) / 2).alias("pr_auc"),
                                   F.sum(d_rec * F.col("precision")).alias("average_precision"))


def loss_scores(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = ()) -> DataFrame:
    """Log loss (probabilities clipped to [eps, 1-eps]) and Brier."""
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(ll).alias("log_loss"), F.avg((F.col(score) - y) ** 2).alias("brier"))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = (),
                    steps: int = 100) -> DataFrame:
    """Metrics at every threshold t = k/steps (p >= t), thresholds
    where every row is predicted one class skipped.  Each score counts once, at the highest threshold it
    reaches (map-side combined); a threshold's counts are the sums of those at or above it: at most steps + 2 rows a group."""
    by = list(by)
    p, n = F.col(score).cast("double"), F.lit(float(steps))
    k = F.floor(F.least(F.greatest(p, F.lit(-1.0)), F.lit(2.0)) * n)
    # the product may round across a threshold: compare with k/steps itself
    k = F.when((k + 1) / n <= p, k + 1).when(k / n > p, k - 1).otherwise(k)
    bins = df.groupBy(*by, F.coalesce(F.greatest(F.least(k, F.lit(steps)), F.lit(-1)), F.lit(-1)).alias("k")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"), F.count_if(F.col(label) == 0).cast("double").alias("neg"))
    per = bins.groupBy(*by).agg(F.collect_list(F.struct("k", "pos", "neg")).alias("bins"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = per.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps))))

    def reached(x):
        return F.aggregate(F.filter("bins", lambda b: b["k"] >= F.col("t")), F.lit(0.0), lambda a, b: a + b[x])

    r = r.withColumn("tp_", reached("pos")).withColumn("fp_", reached("neg"))
    tp, fp = F.col("tp_"), F.col("fp_")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    sens, spec = _div(tp, tp + fn), _div(tn, tn + fp)
    ppv, npv = _div(tp, tp + fp), _div(tn, tn + fn)
    out = r.select(*by, (F.col("t").cast("double") / n).alias("threshold"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                   tn.cast("bigint").alias("tn"), fn.cast("bigint").alias("fn"), sens.alias("sensitivity"),
                   spec.alias("specificity"), ppv.alias("ppv"), npv.alias("npv"),
                   _div(tp + tn, F.col("P") + F.col("N")).alias("accuracy"), _div(2 * ppv * sens, ppv + sens).alias("f1"))
    return out.where((F.col("tp") + F.col("fp") > 0) & (F.col("tn") + F.col("fn") > 0))


def optimal_thresholds(sweep: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Best threshold per criterion (max F1, accuracy, Youden,
    2·sens+spec); ties -> the first (lowest) threshold.  The criteria are stacked, so the sweep runs once; the window
    sees its ≤ 101 rows per group and criterion."""
    crit = {"f1": F.col("f1"), "accuracy": F.col("accuracy"),
            "youden": F.col("sensitivity") + F.col("specificity") - 1,
            "sens2_spec": 2 * F.col("sensitivity") + F.col("specificity")}
    stacked = sweep.select(*by, "threshold", F.inline(F.array(*[F.struct(F.lit(n).alias("criterion"), e.alias("value")) for n, e in crit.items()])))
    w = Window.partitionBy(*by, "criterion").orderBy(F.desc("value"), "threshold")
    return stacked.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "threshold", "value", "criterion")


def calibration_curve(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10,
                      by: list[str] | tuple = ()) -> DataFrame:
    """Uniform bins on [0,1] (p = 1 into the last), mean predicted and
    observed rate; empty bins absent."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.avg(score).alias("mean_predicted"),
                                               F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                                               F.count(F.lit(1)).alias("n"))


def composite_score(metrics: DataFrame) -> DataFrame:
    """.15 acc + .20 prec + .20 rec + .25 f1 + .20 auc."""
    return metrics.withColumn("composite", 0.15 * F.col("accuracy") + 0.20 * F.col("precision")
                              + 0.20 * F.col("recall") + 0.25 * F.col("f1") + 0.20 * F.col("auc"))


def best_per_metric(metrics: DataFrame, key: str, names: list[str], lower_is_better: list[str] | tuple = ()) -> DataFrame:
    """The best ``key`` for every metric — idxmax, or idxmin
    for ``lower_is_better`` metrics; ties -> first in ``key`` order.
    ``metrics`` holds one row per model (small)."""
    long = metrics.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double")
                                                            .alias("value")) for n in names])).alias("m"))
    long = long.select(key, "m.metric", "m.value")
    signed = F.when(F.col("metric").isin(list(lower_is_better)), -F.col("value")).otherwise(F.col("value")) \
        if lower_is_better else F.col("value")
    w = Window.partitionBy("metric").orderBy(signed.desc(), key)
    return long.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def metric_long(metrics: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Model × metric long table (unpivot)."""
    return metrics.select(key, *[F.col(n).cast("double") for n in names]).unpivot([key], names, "metric", "value")
