"""Spark ML queries (rows-only checks: iterative solvers, sampling)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import metrics as ME
from ..operators import multivariate as MV
from ..operators import train as TR
from ..operators.missing import impute
from ..operators.profile import with_class_weight
from ..operators.split import kfold, subset_since, train_test_split
from ..functions.ordering import quantile_dict
from ..operators import neighbours as NB
from ..session import scratch_path, written
from .sqlgen import median_fill
from ..sources.tables import read_table
from . import fixtures as FX
from .registry import register

FEATS = FX.MODEL_FEATURES
KINDS = ["svm_linear", "svm_rbf", "svm_poly", "random_forest", "gbt", "logistic", "decision_tree"]


def training_frame(s, d):
    """Imputed model table with label, stratified 80/20 split and balanced
    class weights."""
    e = impute(FX.scored_encounters(s, d), "median", cols=FX.LABS)
    e = e.select("encounter_id", *FEATS, F.col("appendicitis").alias("label"))
    e = train_test_split(e, "encounter_id", 0.2, stratify="label")
    return with_class_weight(e, "label")


def _standardized(s, d):
    """Training table, standardised with train-split statistics, then
    written to the shared folder as Parquet: every fit/score of an iterative
    learner reads the columns it needs of this table instead of re-running the
    imputation, split and scaling lineage."""
    from ..operators.encode import apply_standard
    t = training_frame(s, d)
    params = TR.standardize_expr(t.where("split = 'train'"), FEATS)[1]
    from ..session import partitions_for_iterations
    return partitions_for_iterations(written(apply_standard(t, params), "standardized"))


def _eval_kind(t, kind, **kw):
    tr, te = t.where("split = 'train'"), t.where("split = 'test'")
    m, feats, secs = TR.fit_model(tr, FEATS, kind, "label", weight_col="weight", **kw)
    ev = ME.evaluate(TR.score(m, te, FEATS, kind), "label", "pred", "score")
    return m, feats, secs, ev


def _q_compare(s, d, parallelism: int = 4):
    """M1-M5 + M18 + M23: every learner trained on the same checkpointed
    table and evaluated on the held-out split; fits are submitted
    concurrently from driver threads (their per-iteration jobs are small, so
    overlapping them uses otherwise idle executor slots)."""
    from concurrent.futures import ThreadPoolExecutor
    t = _standardized(s, d)

    tr, te = t.where("split = 'train'"), t.where("split = 'test'")

    def one(kind):
        m, _, secs = TR.fit_model(tr, FEATS, kind, "label", weight_col="weight")
        # a row is scored once: counts and ranks read the written scores
        scored = written(TR.score(m, te, FEATS, kind).select("label", "pred", "score"), "compared")
        r = ME.evaluate(scored, "label", "pred", "score").collect()[0].asDict()
        r.update(model=kind, train_seconds=secs)
        return r
    with ThreadPoolExecutor(parallelism) as ex:
        rows = list(ex.map(one, KINDS))
    df = s.createDataFrame([(r["model"], r["accuracy"], r["precision"], r["recall"], r["f1"], r["auc"], r["train_seconds"])
                            for r in rows], "model string, accuracy double, precision double, recall double, f1 double, "
                                            "auc double, train_seconds double")
    df = ME.composite_score(df)
    return df.withColumn("auc_per_second", F.try_divide(F.col("auc"), F.col("train_seconds")))


register("m01_m05_model_comparison", family="train")(_q_compare)


def _q_importances(s, d):
    t = _standardized(s, d)
    out = []
    for kind in ["random_forest", "decision_tree", "logistic"]:
        m, feats, _, _ = _eval_kind(t, kind)
        out += [(kind, f, v) for f, v in TR.importances(m, feats)]
    return s.createDataFrame(out, "model string, feature string, importance double")


register("m08_feature_importances", family="train")(_q_importances)


def _folds(s, d, k=5):
    """Training rows with their fold, written: no fit, score or pass of a learner hashes ids again."""
    return written(kfold(_standardized(s, d).where("split = 'train'"), "encounter_id", k, stratify="label"), "folds")


def _q_grid(s, d):
    t = _folds(s, d).cache()
    res = TR.grid_search(t, FEATS, "logistic", [{"C": 0.1}, {"C": 1.0}, {"C": 10.0}], "label", 5)
    t.unpersist()
    return s.createDataFrame([(str(p), m, sd) for p, m, sd in res], "params string, mean_auc double, std_auc double")


register("m06_m07_grid_search_cv", family="train")(_q_grid)


def _q_grid_f1(s, d):
    t = _folds(s, d).cache()
    res = TR.grid_search(t, FEATS, "decision_tree", [{"maxDepth": 3}, {"maxDepth": 5}, {"maxDepth": 8}], "label", 5,
                         scoring="f1")
    t.unpersist()
    return s.createDataFrame([(str(p), m, sd) for p, m, sd in res], "params string, mean_f1 double, std_f1 double")


register("m06_grid_search_cv_f1", family="train")(_q_grid_f1)


# The reference's axes as far as Spark ML has them: gamma is the RBF kernel's alone; trees without a depth limit have Spark's 30;
# min_samples_split and num_leaves have no counterpart.
GRIDS = {
    "svm_linear": [{"C": c} for c in (0.1, 1.0, 10.0, 100.0)],
    "svm_rbf": [{"C": c, "gamma": g} for c in (0.1, 1.0, 10.0, 100.0) for g in ("scale", "auto", 0.01, 0.1)],
    "random_forest": [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m}
                      for n in (100, 200, 300) for d in (10, 20, 30) for m in (1, 2, 4)],
    "gbt": [{"maxIter": n, "stepSize": r, "maxDepth": d} for n in (100, 200, 300) for r in (0.01, 0.05, 0.1) for d in (3, 5, 7, 9)],
    "logistic": [{"C": 0.1}, {"C": 1.0}, {"C": 10.0}],
}


def _q_grid_learners(s, d):
    """M6 for every tuned learner, and M19: the candidate with the best cross-validated AUC is chosen (ties by name)."""
    from ..session import partitions_for_iterations
    # one partition per core at most: a fit is many small jobs, and several fits run at a time
    t = partitions_for_iterations(_folds(s, d)).cache()
    n = t.count() * 4 // 5  # rows of a fold's fit, for C
    rows = [(kind, str(p), m, sd) for kind, grid in GRIDS.items()
            for p, m, sd in TR.grid_search(t, FEATS, kind, grid, "label", 5, parallelism=8, n_rows=n)]
    t.unpersist()
    best = min(rows, key=lambda r: (-r[2], r[0], r[1]))
    return s.createDataFrame([(*r, r == best) for r in rows], "model string, params string, mean_auc double, std_auc double, chosen boolean")


register("m06_m19_grid_search_learners", family="train")(_q_grid_learners)


def _q_perm(s, d):
    t = _standardized(s, d)
    m, feats, _, _ = _eval_kind(t, "logistic")
    return TR.permutation_importance(t.where("split = 'test'"), m, FEATS, "logistic", "encounter_id", "label", repeats=10)


register("m09_permutation_importance", family="train")(_q_perm)


def _q_score(s, d):
    t = _standardized(s, d)
    m, feats, _, _ = _eval_kind(t, "random_forest")
    return TR.score(m, t, FEATS, "random_forest").select("encounter_id", "score", "pred")


register("m10_batch_scoring", family="train")(_q_score)


def _q_curve(s, d, parallelism: int = 4):
    """10 growing subsets × 5 stratified folds, logistic regression;
    train and validation AUC of a fold in one grouped job; fold fits are
    submitted concurrently (driver threads, as CrossValidator.parallelism)."""
    from concurrent.futures import ThreadPoolExecutor

    import numpy as np
    from ..session import cut_lineage
    fracs = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    # rows once, with the smallest share whose subset holds them and their fold: a subset is a filter on one column.  Folds are dealt by another seed than
    # subsets, so that every subset has rows of every fold.
    t = kfold(_standardized(s, d).where("split = 'train'"), "encounter_id", 5, seed=43, stratify="label")
    t = cut_lineage(subset_since(t, "encounter_id", fracs))
    parts = {f: t.where(F.col("since") <= f) for f in fracs}

    def one(job):
        f, k = job
        part = parts[f]
        tr, va = part.where(F.col("fold") != k), part.where(F.col("fold") == k)
        m, _, _ = TR.fit_model(tr, FEATS, "logistic", "label", maxIter=50)
        both = TR.score(m, part, FEATS, "logistic").withColumn(
            "which", F.when(F.col("fold") == k, "val").otherwise("train"))
        got = {r["which"]: r["auc"] for r in ME.auc(both, "label", "score", by=["which"]).collect()}
        return f, k, got["train"], got["val"]

    with ThreadPoolExecutor(parallelism) as ex:
        res = list(ex.map(one, [(f, k) for f in fracs for k in range(5)]))
    out = []
    for f in fracs:
        tr_auc = [r[2] for r in res if r[0] == f]
        va_auc = [r[3] for r in res if r[0] == f]
        gap = float(np.mean(tr_auc) - np.mean(va_auc))
        verdict = "overfitting" if gap > 0.1 else ("underfitting" if np.mean(va_auc) < 0.7 else "good fit")
        out.append((f, float(np.mean(tr_auc)), float(np.std(tr_auc)), float(np.mean(va_auc)), float(np.std(va_auc)), verdict))
    return s.createDataFrame(out, "fraction double, train_mean double, train_std double, val_mean double, val_std double, "
                                  "verdict string")


register("m22_learning_curve", family="train")(_q_curve)


def _rf_scores(s, d):
    """Forest scores of the held-out rows, halved by hash: ``part`` calibrate or judge.  The forest saw neither."""
    t = _standardized(s, d)
    m, _, _, _ = _eval_kind(t, "random_forest")
    sc = TR.score(m, t.where("split = 'test'"), FEATS, "random_forest").select("encounter_id", "label", "score")
    sc = train_test_split(written(sc, "forest-scores"), "encounter_id", 0.5, seed=43)
    return sc.where("split = 'train'").drop("split"), sc.where("split = 'test'").drop("split")


def _brier(df, score="score"):
    return ME.loss_scores(df.withColumn("score", F.col(score)))


def _q_platt(s, d):
    fit, judge = _rf_scores(s, d)
    a, b = TR.fit_platt(fit)
    before = _brier(judge).select(F.col("brier").alias("brier_before"))
    after = _brier(TR.apply_platt(judge, a, b), "calibrated").select(F.col("brier").alias("brier_after"))
    return before.crossJoin(after).select("*", F.lit(a).alias("platt_a"), F.lit(b).alias("platt_b"))


register("c1_platt_scaling", family="calibration")(_q_platt)


def _q_platt_kfold(s, d):
    t = _standardized(s, d)
    tr = written(kfold(t.where("split = 'train'"), "encounter_id", 3, stratify="label"), "folds")
    cal = TR.platt_kfold(tr, FEATS, "logistic", "label", k=3)
    te = t.where("split = 'test'")
    raw = _brier(TR.score(TR.fit_model(t.where("split = 'train'"), FEATS, "logistic", "label")[0], te, FEATS,
                          "logistic")).select(F.col("brier").alias("brier_single_model"))
    after = _brier(cal(te, "encounter_id"), "calibrated").select(F.col("brier").alias("brier_kfold_calibrated"))
    return raw.crossJoin(after)


register("c1_platt_scaling_kfold", family="calibration")(_q_platt_kfold)


def _q_iso(s, d):
    fit, judge = _rf_scores(s, d)
    cal = TR.apply_isotonic(TR.fit_isotonic(fit), judge)
    before = _brier(judge).select(F.col("brier").alias("brier_before"))
    after = _brier(cal, "calibrated").select(F.col("brier").alias("brier_after"))
    return before.crossJoin(after)


register("c2_isotonic_calibration", family="calibration")(_q_iso)


def _q_c5(s, d):
    """Recalibrate when the fitting rows' Brier score is over .1.  Three parts of the held-out rows: one fits the line, one decides whether it helps, and
    the third, which decided nothing, gives the scores that are reported."""
    fit, rest = _rf_scores(s, d)
    rest = train_test_split(rest, "encounter_id", 0.5, seed=44)
    decide, judge = rest.where("split = 'train'").drop("split"), rest.where("split = 'test'").drop("split")

    def brier(df, column="score"):
        return _brier(df, column).collect()[0]["brier"]

    before = after = brier(judge)
    decision = "kept (brier <= .1)"
    if brier(fit) > 0.1:
        a, b = TR.fit_platt(fit)
        decision = "kept (no gain)"
        if brier(TR.apply_platt(decide, a, b), "calibrated") < brier(decide):
            decision, after = "recalibrated", brier(TR.apply_platt(judge, a, b), "calibrated")
    return s.createDataFrame([(before, after, decision)], "brier_before double, brier_after double, decision string")


register("c5_conditional_recalibration", family="calibration")(_q_c5)


def _q_iforest(s, d):
    """D11 on all continuous columns together (contamination .1); the
    per-column variant (.05) is ``d08_outlier_stats_isolation_forest``."""
    e = impute(FX.encounters(s, d), "median", cols=FX.LABS)
    return MV.isolation_forest(e, FX.CONTINUOUS, "encounter_id", contamination=0.1).select(
        "encounter_id", "anomaly_score", "is_outlier")


register("d11_isolation_forest", family="outliers")(_q_iforest)


def _q_mcd(s, d):
    e = impute(FX.encounters(s, d), "median", cols=FX.LABS)
    out, _ = MV.robust_mahalanobis(e, FX.CONTINUOUS, contamination=0.05)
    return out.select("encounter_id", "robust_distance", "is_outlier")


register("d13_robust_mahalanobis", family="outliers")(_q_mcd)


def _q_mcd_checks(s, d):
    """What holds of the robust fit whatever the random starts: the flagged number under both cuts, and a determinant no larger than that of the fit that
    starts from the classical moments."""
    import math
    e = written(impute(FX.encounters(s, d), "median", cols=FX.LABS).select("encounter_id", *FX.CONTINUOUS), "mcd-checks")
    n = e.count()
    fit = MV.fast_mcd(e, FX.CONTINUOUS)
    share, by_share = MV.robust_mahalanobis(e, FX.CONTINUOUS, contamination=0.05, fit=fit)
    cut, _ = MV.robust_mahalanobis(e, FX.CONTINUOUS, percentile=97.5, fit=fit)
    data = e.select(*[F.col(c).cast("double").alias(c) for c in FX.CONTINUOUS])
    single = MV._whole_table_steps(data, FX.CONTINUOUS, [MV._moments(data, FX.CONTINUOUS)], (n + len(FX.CONTINUOUS) + 1) // 2, n, 10)
    ok = by_share["determinant"] <= single[2] * (1 + 1e-9) and math.isfinite(by_share["scale"]) and by_share["scale"] > 0
    flags = share.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_outlier").alias("n_share")).crossJoin(cut.agg(F.count_if("is_outlier").alias("n_percentile")))
    return flags.withColumn("determinant_ok", F.lit(bool(ok)))


register("d13_fast_mcd_checks", FX.with_views("encounters") + "SELECT count(*) AS n_rows, count(*) - 1 - CAST(floor((count(*) - 1) * 0.95) AS BIGINT) AS n_share, "
         "count(*) - 1 - CAST(floor((count(*) - 1) * 0.975) AS BIGINT) AS n_percentile, true AS determinant_ok FROM encounters", family="outliers")(_q_mcd_checks)


KNN_SQL = ("nb AS (SELECT id, nbr, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank "
           "FROM (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist "
           "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) p) q WHERE rank <= 20)")

register("j08_knn_embeddings", "WITH " + KNN_SQL + " SELECT * FROM nb", doubles=["dist"], family="joins")(
    lambda s, d: NB.knn(read_table(s, d, "embeddings"), "vec_id", "embedding", k=20))


def _q_lof(s, d):
    nb = written(NB.knn(read_table(s, d, "embeddings"), "vec_id", "embedding", k=20), "knn")
    lof = written(NB.lof(nb), "lof")
    cut = quantile_dict(lof, ["lof"], [0.95])[("lof", 0.95)]
    return lof.withColumn("is_outlier", F.col("lof") > cut)


register("d14_lof_embeddings",
         "WITH " + KNN_SQL + ", kd AS (SELECT id, max(dist) AS kdist FROM nb GROUP BY id), lrd AS (SELECT nb.id, "
         "1.0 / (avg(greatest(nb.dist, kd.kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.id = nb.nbr GROUP BY nb.id), l AS (SELECT nb.id, "
         "avg(n.lrd) / any_value(o.lrd) AS lof FROM nb JOIN lrd n ON n.id = nb.nbr JOIN lrd o ON o.id = nb.id GROUP BY nb.id) "
         "SELECT id, lof, lof > (SELECT quantile_cont(lof, 0.95) FROM l) AS is_outlier FROM l", doubles=["lof"], family="outliers")(_q_lof)


def ensemble_flags(df, cols, id_col, contamination=0.05):
    """(id, mcd, lof, iforest) over the columns that are neither over 30 % null nor constant (P9), nulls filled with
    the median, scaled by mean and population sd."""
    from ..operators.encode import apply_standard, fit_standard
    n = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols], *[F.var_pop(c).alias(f"{c}__v") for c in cols]).first()
    use = [c for c in cols if n["n"] and n[c] >= 0.7 * n["n"] and (n[f"{c}__v"] or 0) > 0]
    filled = impute(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in use]), "median", cols=use)
    x = written(apply_standard(filled, fit_standard(filled, use)), "ensemble")
    mcd, _ = MV.robust_mahalanobis(x, use, contamination=contamination)
    lof = NB.lof_outliers(x, use, id_col, min(20, max(1, n["n"] - 1)), contamination)
    iso = MV.isolation_forest(x, use, id_col, contamination=contamination)
    j = mcd.select(id_col, F.col("is_outlier").alias("mcd")).join(lof.select(id_col, F.col("is_outlier").alias("lof")), id_col)
    return j.join(iso.select(id_col, F.col("is_outlier").alias("iforest")), id_col)


def _q_ensemble(s, d):
    j = ensemble_flags(FX.encounters(s, d), FX.CONTINUOUS, "encounter_id").withColumn("ensemble", F.col("mcd") | F.col("lof") | F.col("iforest"))
    agg = j.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ["mcd", "lof", "iforest", "ensemble"]])
    return agg.selectExpr("stack(4, 'mcd', mcd, 'lof', lof, 'iforest', iforest, 'ensemble', ensemble) AS (detector, n_outliers)", "n") \
        .withColumn("pct", F.col("n_outliers") * 100.0 / F.col("n")).drop("n")


register("d15_ensemble_vote", family="outliers")(_q_ensemble)


def _q_ensemble_checks(s, d):
    """What holds of the vote whatever the samples: every row has one, distances and factors are cut by exact rank, forest scores (which may tie at the cut) flag no more
    than that, and the union lies between its largest part and their sum."""
    j = ensemble_flags(FX.encounters(s, d), FX.CONTINUOUS, "encounter_id")
    a = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("mcd").alias("n_mcd"), F.count_if("lof").alias("n_lof"), F.count_if("iforest").alias("n_forest"),
              F.count_if(F.col("mcd") | F.col("lof") | F.col("iforest")).alias("n_any"))
    return a.select("n_rows", "n_mcd", "n_lof", ((F.col("n_forest") > 0) & (F.col("n_forest") <= F.col("n_mcd"))).alias("forest_ok"),
                    F.col("n_any").between(F.greatest("n_mcd", "n_lof", "n_forest"), F.col("n_mcd") + F.col("n_lof") + F.col("n_forest")).alias("union_ok"))


register("d15_ensemble_checks", FX.with_views("encounters") + "SELECT count(*) AS n_rows, count(*) - 1 - CAST(floor((count(*) - 1) * 0.95) AS BIGINT) AS n_mcd, "
         "count(*) - 1 - CAST(floor((count(*) - 1) * 0.95) AS BIGINT) AS n_lof, true AS forest_ok, true AS union_ok FROM encounters", family="outliers")(_q_ensemble_checks)


def _q_pipeline(s, d):
    from pyspark.ml.functions import vector_to_array
    t = training_frame(s, d)
    p = TR.column_group_pipeline(FX.LABS, ["age", "duration"], FX.SYMPTOM_FLAGS).fit(t.where("split = 'train'"))
    v = vector_to_array("features")
    return p.transform(t).select("encounter_id", "split", *[v[i].alias(c) for i, c in enumerate([*FX.LABS, "age", "duration", *FX.SYMPTOM_FLAGS])])


def _e20_sql():
    labs = ", ".join(f"(f.{c} - avg(f.{c}) FILTER (WHERE f.split = 'train') OVER ()) / stddev_pop(f.{c}) FILTER (WHERE f.split = 'train') OVER () AS {c}" for c in FX.LABS)
    span = ", ".join(f"(f.{c} - min(f.{c}) FILTER (WHERE f.split = 'train') OVER ()) / (max(f.{c}) FILTER (WHERE f.split = 'train') OVER () - "
                     f"min(f.{c}) FILTER (WHERE f.split = 'train') OVER ()) AS {c}" for c in ("age", "duration"))
    flags = ", ".join(f"CAST(f.{c} AS DOUBLE) AS {c}" for c in FX.SYMPTOM_FLAGS)
    from ..operators.split import split_sql_expr
    return (FX.with_views("scored") + f", imp AS ({median_fill('scored', FX.LABS)}), f AS (SELECT *, "
            f"{split_sql_expr('encounter_id', partition='appendicitis')} AS split FROM imp) SELECT encounter_id, split, {labs}, {span}, {flags} FROM f")


register("e20_column_group_pipeline", _e20_sql(), doubles=[*FX.LABS, "age", "duration", *FX.SYMPTOM_FLAGS], family="features")(_q_pipeline)


def _q_pca(s, d):
    e = impute(FX.scored_encounters(s, d), "median", cols=FX.LABS)
    ev, cum, _ = TR.pca(e, FEATS)
    return s.createDataFrame([(i + 1, v, c) for i, (v, c) in enumerate(zip(ev, cum))],
                             "component int, explained_variance double, cumulative double")


register("e22_w5_pca_explained_variance", family="features")(_q_pca)


def _q_pca_proj(s, d):
    e = impute(FX.scored_encounters(s, d), "median", cols=FX.LABS)
    _, _, proj = TR.pca(e, FEATS)
    return proj.select("encounter_id", "pc1", "pc2")


register("e22_pca_projection", family="features")(_q_pca_proj)


def _q_pca_moments(s, d):
    """What any correct PCA of standardised columns has: variances that sum to the number of columns and whose squares sum to those of all correlations,
    a running share that rises to 1 (W5), and projections without correlation whose variances are the first two."""
    e = written(impute(FX.scored_encounters(s, d), "median", cols=FX.LABS), "pca-rows")
    ev, cum, proj = TR.pca(e, FEATS)
    var = [v * len(FEATS) for v in ev]
    got = proj.agg(F.var_pop("pc1").alias("one"), F.var_pop("pc2").alias("two"), F.covar_pop("pc1", "pc2").alias("both")).first()
    falling = all(a >= b - 1e-12 for a, b in zip(ev, ev[1:])) and all(abs(c - sum(ev[:i + 1])) < 1e-9 for i, c in enumerate(cum))
    projected = abs(got["one"] - var[0]) < 1e-6 and abs(got["two"] - var[1]) < 1e-6 and abs(got["both"]) < 1e-6
    return s.createDataFrame([(len(ev), sum(var), sum(v * v for v in var), cum[-1], falling, projected)],
                             "components bigint, variance double, squares double, last_share double, falling_ok boolean, projection_ok boolean")


register("e22_w5_pca_moments",
         FX.with_views("scored") + f", imp AS ({median_fill('scored', FX.LABS)}) SELECT CAST({len(FEATS)} AS BIGINT) AS components, CAST({len(FEATS)} AS DOUBLE) AS variance, "
         + " + ".join(f"pow(corr({a}, {b}), 2)" for a in FEATS for b in FEATS)
         + " AS squares, CAST(1 AS DOUBLE) AS last_share, true AS falling_ok, true AS projection_ok FROM imp",
         doubles=["variance", "squares", "last_share"], family="features")(_q_pca_moments)


def _q_x7(s, d):
    """Platt scaling fitted on the training rows, the strongest feature beside it, on the row itself."""
    from .q_misc import contributions
    from ..operators.explain import top_features
    c = contributions(s, d)
    top = top_features(c.withColumn("contributions", F.col("contributions")), "encounter_id", 1)
    c = written(c.select("encounter_id", (1.0 / (1.0 + F.exp(-F.col("prediction")))).alias("score")), "explained")
    lab = train_test_split(FX.encounters(s, d).select("encounter_id", F.col("appendicitis").alias("label")), "encounter_id")
    a, b = TR.fit_platt(c.join(lab.where("split = 'train'"), "encounter_id"))
    top = top.select("encounter_id", F.col("feature").alias("top_feature"), "direction")
    return TR.apply_platt(c, a, b).join(top, "encounter_id").select("encounter_id", "score", "calibrated", "top_feature", "direction")


register("x07_calibrated_explanation", family="attribution")(_q_x7)


def _q_registry(s, d):
    """Three saved pipelines; the calibrated one is really calibrated: it learns from part of the training rows and its Platt line from the rest."""
    from ..operators.calibrated import medians, serve, serving_pipeline
    from ..sources.registry import save_model
    import time
    root = scratch_path(s, "registry")
    t = train_test_split(FX.scored_encounters(s, d).select("encounter_id", *FEATS, F.col("appendicitis").alias("label")), "encounter_id", 0.2, stratify="label")
    t = written(t, "registry-rows")
    tr, te = t.where("split = 'train'"), t.where("split = 'test'")
    own = written(train_test_split(tr.drop("split"), "encounter_id", 0.25, seed=43), "registry-own")
    fills = medians(tr, FEATS)
    base = dt.datetime(2024, 1, 1)
    for i, (name, kind, cal) in enumerate(REGISTERED):
        t0 = time.time()
        m = serving_pipeline(own.where("split = 'train'") if cal else tr, FEATS, kind, "label", fills, own.where("split = 'test'") if cal else None)
        r = {"train_seconds": time.time() - t0}
        # a row is scored once: counts and ranks read the written scores
        scored = written(serve(m, te).select("label", "pred", "score"), "registry-scores")
        r |= ME.evaluate(scored, "label", "pred", "score").collect()[0].asDict()
        save_model(s, m, root, name, kind, r, base + dt.timedelta(hours=i), calibrated=cal)
    return s.read.parquet(f"{root}/model_registry")


REGISTERED = [("best_model_rf", "random_forest", False), ("standard_lr", "logistic", False), ("calibrated_lr", "logistic", True)]


def _q_registry_choice(s, d):
    from ..sources.registry import choose_model
    return choose_model(_q_registry(s, d)).select("name", "kind", "version", "priority")


# the same choice over the registry's rows as SQL: calibrated, then other than best_model*, newest first
register("s10_s11_model_registry",
         "SELECT name, kind, version, CAST(priority AS INTEGER) AS priority FROM (SELECT *, CASE WHEN calibrated THEN 0 WHEN NOT starts_with(name, 'best_model') THEN 1 ELSE 2 END "
         "AS priority FROM (VALUES " + ", ".join(f"('{n}', '{k}', {str(c).lower()}, '20240101_{i:02d}0000')" for i, (n, k, c) in enumerate(REGISTERED))
         + ") t(name, kind, calibrated, version)) r ORDER BY priority, version DESC, name LIMIT 1", family="sources")(_q_registry_choice)


def _q_efficiency(s, d):
    from ..sources.registry import efficiency
    return efficiency(_q_registry(s, d))


register("m23_efficiency", family="train")(_q_efficiency)


#: Rows that stand for the others where a feature is absent: a parameter of the sampling method.
BACKGROUND_ROWS = 100


def _q_x1_sampled(s, d):
    """X1 (any model): sampled Shapley values of the random forest on every row."""
    from ..operators.explain import sampled_shapley
    from ..functions.ordering import hash_key
    t = _standardized(s, d)
    m, _, _, _ = _eval_kind(t, "random_forest")
    bg = t.where("split = 'train'").withColumn("_hk", hash_key("encounter_id")).orderBy("_hk", "encounter_id").limit(BACKGROUND_ROWS)

    def model_score(frame):
        return TR.score(m, frame, FEATS, "random_forest")
    return sampled_shapley(t, model_score, FEATS, "encounter_id", bg, n_perm=10)


register("x01_sampled_shapley_forest", family="attribution")(_q_x1_sampled)


MH = ["age", "duration"]


def _q_mahalanobis(s, d):
    """D13 classical single-pass variant (population covariance)."""
    e = FX.encounters(s, d)
    return MV.classical_mahalanobis(e, MH).select("encounter_id", "mahalanobis_sq")


def _mahalanobis_sql():
    a, b = MH
    return (FX.with_views("encounters") + f", m AS (SELECT avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS vaa, "
            f"var_pop({b}) AS vbb, covar_pop({a}, {b}) AS cab FROM encounters) SELECT encounter_id, "
            f"(vbb * ({a} - ma) * ({a} - ma) - 2 * cab * ({a} - ma) * ({b} - mb) + vaa * ({b} - mb) * ({b} - mb)) / "
            "(vaa * vbb - cab * cab) AS mahalanobis_sq FROM encounters, m")


register("d13_classical_mahalanobis", _mahalanobis_sql(), doubles=["mahalanobis_sq"], family="outliers")(_q_mahalanobis)
