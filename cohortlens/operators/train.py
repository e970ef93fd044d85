"""Model training, tuning, scoring and calibration on Spark ML (M1-M10,
M22, C1, C2, C5, E20, E22).

Learners are Spark ML estimators (distributed tree/GLM solvers).  Folds,
subsets and splits come from the seeded hash order, never ``rand``.  Only
k×k matrices, coefficient vectors and metric rows reach the driver.
"""

from __future__ import annotations

import math
import time
from functools import reduce

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auc as auc_of
from .metrics import evaluate


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def standardize_expr(df: DataFrame, features: list[str]) -> tuple[DataFrame, dict]:
    """Population standardisation as expressions (fit = one agg)."""
    from .encode import apply_standard, fit_standard
    p = fit_standard(df, features)
    return apply_standard(df, p), p


def rff_columns(features: list[str], n_components: int = 50, gamma: float | None = None, seed: int = 42) -> list:
    """M1 RBF kernel via random Fourier features: sqrt(2/D)·cos(W·x + b),
    W ~ N(0, 2γ), b ~ U(0, 2π) (seeded).  Built as JVM expressions."""
    k = len(features)
    gamma = gamma if gamma is not None else 1.0 / k
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, k))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    cols = []
    for i in range(n_components):
        lin = sum((F.col(f) * float(W[i, j]) for j, f in enumerate(features)), F.lit(float(b[i])))
        cols.append((F.cos(lin) * scale).alias(f"rff_{i}"))
    return cols


def make_learner(kind: str, label: str = "label", weight_col: str | None = None, n_rows: int | None = None, **kw):
    """M1-M5 estimators with reference-like defaults."""
    common = {"labelCol": label, "featuresCol": "features"}
    if kind in ("svm_linear", "svm_rbf", "svm_poly"):
        reg = 1.0 / (kw["C"] * max(n_rows or 1, 1)) if "C" in kw else kw.get("regParam", 0.01)
        est = LinearSVC(maxIter=kw.get("maxIter", 50), regParam=reg, **common)
    elif kind == "random_forest":
        est = RandomForestClassifier(numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", 10),
                                     minInstancesPerNode=kw.get("minInstancesPerNode", 1), seed=42, cacheNodeIds=True, **common)
    elif kind == "gbt":
        est = GBTClassifier(maxIter=kw.get("maxIter", 50), maxDepth=kw.get("maxDepth", 3), stepSize=kw.get("stepSize", 0.1),
                            seed=42, **common)
    elif kind == "logistic":
        C = kw.get("C", 1.0)
        est = LogisticRegression(maxIter=kw.get("maxIter", 100), regParam=1.0 / (C * max(n_rows or 1, 1)),
                                 elasticNetParam=0.0, **common)
    elif kind == "decision_tree":
        est = DecisionTreeClassifier(maxDepth=kw.get("maxDepth", 4), seed=42, **common)
    else:
        raise ValueError(kind)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est


def rbf_gamma(df: DataFrame, features: list[str], gamma: float | str | None) -> float | None:
    """A kernel width by name: ``auto`` is 1/k, ``scale`` 1/(k·variance of all entries of ``df``)."""
    if gamma == "scale":
        values = F.array(*[F.col(f).cast("double") for f in features])
        var = df.select(F.explode(values).alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
        return 1.0 / (len(features) * (var or 1.0))
    return 1.0 / len(features) if gamma == "auto" else gamma


def prepare_matrix(df: DataFrame, features: list[str], kind: str, gamma: float | None = None) -> tuple[DataFrame, list[str]]:
    """Feature columns for a learner kind: RBF -> RFF columns, poly -> E19
    degree-2 products, others as is."""
    if kind == "svm_rbf":
        cols = rff_columns(features, gamma=gamma)
        out = df.select("*", *cols)
        return out, [f"rff_{i}" for i in range(len(cols))]
    if kind == "svm_poly":
        names = [(a, b) for i, a in enumerate(features) for b in features[i:]]
        out = df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}__x__{b}") for a, b in names])
        return out, features + [f"{a}__x__{b}" for a, b in names]
    return df, features


def fit_model(df: DataFrame, features: list[str], kind: str, label: str = "label", weight_col: str | None = None, **kw):
    """Train one model; returns (fitted PipelineModel-like, feature list)."""
    data, feats = prepare_matrix(df, features, kind, kw.pop("gamma", None))
    data = assemble(data, feats)
    est = make_learner(kind, label, weight_col, n_rows=kw.pop("n_rows", None), **kw)
    t0 = time.time()
    model = est.fit(data)
    return model, feats, time.time() - t0


def score(model, df: DataFrame, features: list[str], kind: str, gamma: float | None = None) -> DataFrame:
    """Class + probability.  Models without probabilities (SVM) get the
    decision value min-max scaled over the scored table (the fallback)."""
    data, feats = prepare_matrix(df, features, kind, gamma)
    out = model.transform(assemble(data, feats))
    if "probability" in out.columns:
        return out.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int"))
    raw = vector_to_array("rawPrediction")[1]
    out = out.withColumn("_raw", raw)
    mm = out.agg(F.min("_raw").alias("_mn"), F.max("_raw").alias("_mx"))
    out = out.crossJoin(F.broadcast(mm))
    return (out.withColumn("score", F.try_divide(F.col("_raw") - F.col("_mn"), F.col("_mx") - F.col("_mn")))
            .withColumn("pred", F.col("prediction").cast("int")).drop("_mn", "_mx"))


def importances(model, feats: list[str]) -> list[tuple[str, float]]:
    """M8: feature importances (trees) or |coefficients| (linear), sorted."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    else:
        v = np.abs(model.coefficients.toArray())
    return sorted(zip(feats, [float(x) for x in v]), key=lambda t: (-t[1], t[0]))


def cross_validate(df: DataFrame, features: list[str], kind: str, label: str = "label", fold_col: str = "fold",
                   k: int = 5, scoring: str = "auc", **kw) -> dict:
    """M6/M7: k-fold score (folds from the stratified hash order), AUC or F1
    of the positive class; mean and population std over folds.  The held-out rows of all folds are scored and ranked together."""
    from .metrics import confusion, with_rates
    held = []
    for f in range(k):
        tr, va = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        gamma = rbf_gamma(tr, features, kw.get("gamma"))
        m, feats, _ = fit_model(tr, features, kind, label, **{**kw, "gamma": gamma})
        held.append(score(m, va, features, kind, gamma).select(F.lit(f).alias("_of"), label, "score", "pred"))
    rows = reduce(DataFrame.unionByName, held)
    if scoring == "f1":
        found = {r["_of"]: r["f1"] for r in with_rates(confusion(rows, label, "pred", by=["_of"])).collect()}
        vals = [found.get(f, 0.0) for f in range(k)]
    else:
        found = {r["_of"]: r["auc"] for r in auc_of(rows, label, "score", by=["_of"]).collect()}
        vals = [found.get(f) for f in range(k)]
    return {"mean_auc": float(np.mean(vals)), "std_auc": float(np.std(vals)), "fold_auc": vals,
            "scoring": scoring}


def grid_search(df: DataFrame, features: list[str], kind: str, grid: list[dict], label: str = "label", k: int = 5,
                parallelism: int = 4, scoring: str = "auc", **fixed) -> list:
    """M6: grid × folds, evaluated concurrently (driver threads submitting Spark jobs, as ``CrossValidator(parallelism=…)``); returns
    [(params, mean_auc, std_auc)] best first.  Boosting and forests are fitted once for all rounds, sizes and depths
    (``staged``); every other candidate is fitted by itself."""
    from concurrent.futures import ThreadPoolExecutor

    from . import staged
    if scoring == "auc" and any(a in p for p in grid for a in staged.NESTED.get(kind, ())):
        def fit(rows, params):
            return fit_model(rows, features, kind, label, **params, **fixed)[0]

        jobs = [(f, g) for g in staged.groups(kind, grid) for f in range(k)]
        with ThreadPoolExecutor(parallelism) as ex:
            each = list(ex.map(lambda j: staged.fold_aucs(df.where(F.col("fold") != j[0]), df.where(F.col("fold") == j[0]), features, kind, label, j[1], fit), jobs))
        aucs: dict[str, list] = {}
        for found in each:
            for params, value in found:
                aucs.setdefault(str(sorted(params.items())), []).append(value)
        res = [(p, float(np.mean(v)), float(np.std(v))) for p in grid for v in [aucs[str(sorted(p.items()))]]]
    else:
        def one(params):
            cv = cross_validate(df, features, kind, label, k=k, scoring=scoring, **params, **fixed)
            return params, cv["mean_auc"], cv["std_auc"]
        with ThreadPoolExecutor(parallelism) as ex:
            res = list(ex.map(one, grid))
    return sorted(res, key=lambda r: (-r[1], str(r[0])))


# ---- calibration -------------------------------------------------------------------

def fit_platt(df: DataFrame, score_col: str = "score", label: str = "label"):
    """Platt scaling — 1-feature logistic fit on the score with Platt's
    smoothed targets, as two weighted rows per record."""
    cnt = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect()[0]
    hi, lo = (cnt["p"] + 1.0) / (cnt["p"] + 2.0), 1.0 / (cnt["n"] + 2.0)
    t = F.when(F.col(label) == 1, F.lit(hi)).otherwise(F.lit(lo))
    two = df.select(F.col(score_col).alias("s"), t.alias("t")).select(
        "s", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")),
                               F.struct(F.lit(0.0).alias("y"), (1 - F.col("t")).alias("w")))).alias("r"))
    two = assemble(two.select("s", "r.y", "r.w"), ["s"])
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=0.0, maxIter=100)
    m = lr.fit(two)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(df: DataFrame, a: float, b: float, score_col: str = "score", out: str = "calibrated") -> DataFrame:
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(score_col) * a + b))))


POOLED = 5_000


def score_groups(df: DataFrame, score_col: str = "score", label: str = "label") -> DataFrame:
    """Neighbouring scores in at most 2 × ``POOLED`` groups: (s, y, w), the mean score, the share of label 1 and the rows.  The edges are
    exact quantiles of the rows and of the distinct scores, so up to ``POOLED`` distinct scores stay apart whatever lies between them."""
    from ..functions.ordering import running_sum
    each = (df.where(F.col(score_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s"))
            .agg(F.sum(F.col(label).cast("double")).alias("good"), F.count(label).alias("n"), F.lit(1).cast("bigint").alias("one")).where("n > 0"))
    at = running_sum(each, "s", ["n", "one"], prefix="to_")
    # the totals are the last running sums: one row
    at = at.crossJoin(F.broadcast(at.agg(F.max("to_n").alias("rows"), F.max("to_one").alias("kinds"))))
    cell = [F.floor((F.col(f"to_{c}") - F.col(c)) * F.lit(POOLED) / F.col(total)).alias(f"by_{c}") for c, total in (("n", "rows"), ("one", "kinds"))]
    mean = F.when(F.min("s") == F.max("s"), F.min("s")).otherwise(F.sum(F.col("s") * F.col("n")) / F.sum("n"))
    return at.groupBy(*cell).agg(mean.alias("s"), (F.sum("good") / F.sum("n")).alias("y"), F.sum("n").cast("double").alias("w")).select("s", "y", "w")


def fit_isotonic(df: DataFrame, score_col: str = "score", label: str = "label"):
    """Isotonic calibration (Spark ML, pool-adjacent-violators), one weighted row per group of ``score_groups`` at the driver."""
    groups = score_groups(df, score_col, label)
    return IsotonicRegression(featuresCol="features", labelCol="y", weightCol="w", isotonic=True).fit(assemble(groups, ["s"]))


def apply_isotonic(model, df: DataFrame, score_col: str = "score", out: str = "calibrated") -> DataFrame:
    d = assemble(df.withColumn("s", F.col(score_col)), ["s"])
    return model.setFeaturesCol("features").setPredictionCol(out).transform(d).drop("features", "s")


# ---- feature pipelines -------------------------------------------------------------------

class GroupScaler:
    """The fitted column groups as expressions."""

    def __init__(self, exprs):
        self.exprs = exprs

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.array(*self.exprs)))


class column_group_pipeline:
    """Column groups each with their own transform (standardised with the population sd, scaled to 0..1), rest passed through."""

    def __init__(self, standard_cols: list[str], minmax_cols: list[str], passthrough: list[str]):
        self.standard, self.minmax, self.rest = standard_cols, minmax_cols, passthrough

    def fit(self, df: DataFrame) -> GroupScaler:
        r = df.agg(*[f(c).cast("double").alias(f"{c}__{n}") for c in [*self.standard, *self.minmax]
                     for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
        std = [(F.col(c) - r[f"{c}__m"]) / (r[f"{c}__s"] or 1.0) for c in self.standard]
        mm = [(F.col(c) - r[f"{c}__lo"]) / ((r[f"{c}__hi"] - r[f"{c}__lo"]) or 1.0) for c in self.minmax]
        return GroupScaler([x.cast("double") for x in [*std, *mm, *map(F.col, self.rest)]])


def pca(df: DataFrame, features: list[str], k: int | None = None):
    """E22 + W5: standardise (population), PCA, explained variance and its
    running sum, 2-D projection.  Signs fixed so each component's largest
    |loading| is positive."""
    z, _ = standardize_expr(df, features)
    data = assemble(z, features)
    k = k or len(features)
    m = PCA(k=k, inputCol="features", outputCol="pcs").fit(data)
    pc = m.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    ev = [float(x) for x in m.explainedVariance.toArray()]
    cum = [float(x) for x in np.cumsum(ev)]
    proj = m.transform(data).select("*", *[(vector_to_array("pcs")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(min(2, k))])
    return ev, cum, proj


def permutation_importance(df: DataFrame, model, features: list[str], kind: str, id_col: str, label: str = "label",
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """M9: AUC drop when one feature is shuffled, per (feature, repeat), then mean and population std per feature.

    Rows get a position; a repeat's shuffle is a keyed bijection of the positions (``permuted_position``), so every row knows by itself where its values go.
    One narrow row (position, repeat, values) a row and repeat is exchanged and serves all features; the (feature, repeat) variants are made
    and scored on the row that received it.  A feature's column is permuted as it is alone: the others stay in place."""
    from ..functions.ordering import global_row_number, permuted_position
    from ..session import written
    base_auc = auc_of(score(model, df, features, kind), label, "score").collect()[0]["auc"]
    placed = global_row_number(df.select(id_col, label, *features), [id_col], name="_at")
    rows = written(placed.withColumn("_at", F.col("_at") - 1), "placed")
    n = rows.count()
    target = permuted_position(F.col("_at"), n, F.col("rep"), seed)
    sent = (rows.select("_at", F.array(*[F.col(f).cast("double") for f in features]).alias("_sent"), F.explode(F.array(*map(F.lit, range(repeats)))).alias("rep"))
            .select(target.alias("_at"), "rep", "_sent"))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_sent", F.lit(i)).alias("value")) for i, f in enumerate(features)])
    # rows sent are many times what a plan takes them for (an array counts as one value, copies are not counted): they are never broadcast
    met = rows.join(sent.hint("merge"), "_at").select(label, *features, "rep", F.explode(each).alias("_v")).select(label, *features, "rep", "_v.*")
    mixed = met.select(label, "rep", "feature", *[F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f)).alias(f) for f in features])
    a = auc_of(score(model, mixed, features, kind), label, "score", by=["feature", "rep"])
    return a.groupBy("feature").agg((F.lit(base_auc) - F.avg("auc")).alias("importance_mean"),
                                    F.stddev_pop("auc").alias("importance_std"))


def platt_kfold(df: DataFrame, features: list[str], kind: str, label: str = "label", fold_col: str = "fold",
                k: int = 3, **kw):
    """C1, k-fold form: for each fold, fit the learner on the other folds and
    Platt-scale it on the held-out fold; the calibrated probability of a new
    row is the mean of the k calibrated predictors.  Returns a function
    ``DataFrame -> DataFrame`` adding ``calibrated``."""
    members = []
    for f in range(k):
        tr, va = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        m, _, _ = fit_model(tr, features, kind, label, **dict(kw))
        a, b = fit_platt(score(m, va, features, kind), "score", label)
        members.append((m, a, b))

    def apply(rows: DataFrame, id_col: str) -> DataFrame:
        # every member scores the row where it stands: one pass and one exchanged row, not one a member
        u, parts = rows.select(id_col, *features), []
        for i, (m, a, b) in enumerate(members):
            parts.append(f"_p{i}")
            u = score(m, u, features, kind).select(id_col, *features, *parts[:-1], (1.0 / (1.0 + F.exp(-(F.col("score") * a + b)))).alias(parts[-1]))
        mean = reduce(lambda x, y: x + y, [F.avg(p) for p in parts]) / len(parts)
        return rows.join(u.groupBy(id_col).agg(mean.alias("calibrated")), id_col)
    return apply
