import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.ordering import grid_sides, permuted_position
from cohortlens.operators import multivariate as MV


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 26, 97, 1000, 4999])
def test_permuted_position_is_a_bijection(spark, n):
    df = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"))
    rows = df.select("id", "rep", permuted_position(F.col("id"), n, F.col("rep")).alias("to")).collect()
    to = {rep: {r["id"]: r["to"] for r in rows if r["rep"] == rep} for rep in (0, 1)}
    assert all(sorted(t.values()) == list(range(n)) for t in to.values())
    if n >= 97:
        moved = [np.mean([k != v for k, v in t.items()]) for t in to.values()]
        assert min(moved) > 0.9 and to[0] != to[1]
        x = np.array([to[0][i] for i in range(n)])
        assert abs(np.corrcoef(np.arange(n), x)[0, 1]) < 4 / n ** 0.5


def test_grid_is_tight():
    for n in (10 ** 6 + 3, 10 ** 9 + 7, 10 ** 12 + 39):
        a, b = grid_sides(n)
        assert 0 <= a * b - n <= 64


def test_permutation_importance_by_force(spark):
    from cohortlens.operators.train import fit_model, permutation_importance, score
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (230, 3))
    y = (2 * x[:, 0] - x[:, 1] + rng.logistic(size=230) > 0).astype(int)
    feats = ["a", "b", "c"]
    df = spark.createDataFrame([(i * 3, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int").repartition(3)
    model, _, _ = fit_model(df, feats, "logistic")
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in permutation_importance(df, model, feats, "logistic", "id", repeats=4).collect()}
    places = spark.range(230).select("id", F.explode(F.array(*map(F.lit, range(4)))).alias("rep"))
    to = {(r["rep"], r["id"]): r["to"] for r in places.select("id", "rep", permuted_position(F.col("id"), 230, F.col("rep")).alias("to")).collect()}
    w, b = model.coefficients.toArray(), model.intercept

    def auc(z):
        pos, neg = z[y == 1], z[y == 0]
        return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))

    base = auc(x @ w + b)
    for j, f in enumerate(feats):
        each = []
        for rep in range(4):
            moved = x.copy()
            for i in range(230):
                moved[to[rep, i], j] = x[i, j]
            assert sorted(moved[:, j]) == sorted(x[:, j])
            each.append(auc(moved @ w + b))
        assert got[f] == pytest.approx((base - np.mean(each), np.std(each)), abs=1e-9)


def test_chi_square():
    assert MV.chi2_quantile(0.5, 1) == pytest.approx(0.4549364, abs=1e-6)  # fixed values of the usual tables
    assert MV.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert MV.chi2_quantile(0.975, 2) == pytest.approx(-2 * np.log(0.025), abs=1e-9)
    assert MV.chi2_cdf(0.0, 3) == 0.0 and MV.chi2_cdf(200.0, 3) == pytest.approx(1.0)


def shifted(spark, n_good=700, n_bad=560, seed=3):
    """Nearly half of the rows lie in one tight far cluster, so the coordinate medians and the classical moments stand between the two."""
    rng = np.random.default_rng(seed)
    good = rng.normal(0, 1, (n_good, 2)) @ np.array([[1.0, 0.8], [0.0, 0.6]])
    x = np.vstack([good, rng.normal(0, 0.6, (n_bad, 2)) + [4.0, -4.0]])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(3)


def test_random_starts_find_the_majority(spark):
    x, df = shifted(spark)
    fit = MV.fast_mcd(df, ["a", "b"])
    n, h = len(x), (len(x) + 3) // 2
    # no determinant of a C-step path from any of many single starts, run out on all rows, lies below
    rng = np.random.default_rng(1)
    least = np.inf
    for _ in range(60):
        sub = x[rng.choice(n, 3, replace=False)]
        mu, cov = sub.mean(axis=0), np.cov(sub, rowvar=False, bias=True)
        for _ in range(30):
            mu, cov, det = MV._c_step(x, mu, cov, h)
        least = min(least, det)
    assert fit["determinant"] <= least * 1.02
    out, params = MV.robust_mahalanobis(df, ["a", "b"], percentile=97.5)
    flags = {r["id"]: (r["robust_distance"], r["is_outlier"]) for r in out.collect()}
    assert sum(f for _, f in flags.values()) == n - 1 - int((n - 1) * 0.975)
    far = [flags[i][0] for i in range(700, n)]
    assert np.median(far) > 5 * np.median([flags[i][0] for i in range(700)])
    assert np.allclose(params["location"], 0, atol=0.3)


def test_reweighted_covariance_is_consistent_on_normal_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (3000, 3)) * [1.0, 2.0, 0.5]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0)], "a double, b double, c double")
    fit = MV.fast_mcd(df, ["a", "b", "c"])
    assert np.allclose(np.diag(fit["covariance"]) / [1.0, 4.0, 0.25], 1.0, atol=0.15)
    out, _ = MV.robust_mahalanobis(df, ["a", "b", "c"])
    assert [r["is_outlier"] for r in out.where("a IS NULL").collect()] == [False]


def test_distance_cuts_are_exact_quantiles(spark, monkeypatch):
    """One count a pass and fit: no expression per finalist and column pair, and the same cut as all distances sorted."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    x[:300] = x[0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    fits = [(np.zeros(3), np.eye(3)), (x[0], np.eye(3) * 2)]
    d = [MV._squares(list(x.T), mu, np.linalg.pinv(cov)) for mu, cov in fits]
    for rows in (2048, 10):
        monkeypatch.setattr(MV, "READ_ROWS", rows)
        for p in (0.0, 0.0123, 0.5, 1.0):
            assert MV._distance_cuts(df, ["a", "b", "c"], fits, p) == pytest.approx([float(np.quantile(v, p)) for v in d], rel=1e-14)
    mu, cov = MV._near_moments(df, ["a", "b", "c"], fits, [float(np.quantile(v, 0.5)) for v in d])[1]
    near = x[d[1] <= np.quantile(d[1], 0.5)]
    assert np.allclose(mu, near.mean(axis=0)) and np.allclose(cov, np.cov(near, rowvar=False, bias=True))


def test_permuted_rows_are_not_broadcast(spark, monkeypatch):
    """Every row goes out once a repeat: an input's multiple, which no broadcast may hold."""
    from cohortlens.operators import train as TR
    plans = []

    def auc_of(df, *args, by=(), **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.groupBy(*by).agg(F.avg("label").alias("auc"))

    monkeypatch.setattr(TR, "auc_of", auc_of)
    monkeypatch.setattr(TR, "score", lambda model, df, *a: df)
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("label"))
    TR.permutation_importance(df, None, ["a"], "logistic", "id", repeats=4)
    assert len(plans) == 2 and "BroadcastHashJoin" not in plans[1]
