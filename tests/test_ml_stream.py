import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.plans.fixtures import MODEL_FEATURES


def test_train5_end_to_end(spark):
    from cohortlens.operators.train import fit_model, score
    rng = np.random.default_rng(0)
    rows = [tuple(float(x) for x in rng.random(len(MODEL_FEATURES))) + (lab,) for lab in [1, 0, 1, 0, 0]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in MODEL_FEATURES) + ", label int")
    m, feats, _ = fit_model(df, MODEL_FEATURES, "random_forest", numTrees=5)
    out = score(m, df, MODEL_FEATURES, "random_forest").collect()
    assert all(r["pred"] in (0, 1) and 0.0 <= r["score"] <= 1.0 for r in out)


def test_platt_monotone(spark):
    from cohortlens.operators.train import apply_platt, fit_platt
    rng = np.random.default_rng(1)
    s = rng.random(400)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    a, b = fit_platt(df)
    assert a > 0
    out = apply_platt(df, a, b).orderBy("score").toPandas()
    assert out["calibrated"].is_monotonic_increasing


def test_isotonic_resolution_follows_the_scores(spark, monkeypatch):
    """Scores of a rare class, all below 1e-4: every distinct score is its own step; above the bound, groups stay bounded and even."""
    from cohortlens.operators import train
    rows = [(k * 1e-7, int(n < k)) for k in range(1, 21) for n in range(20)] + [(None, 1), (0.9, None)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(3)
    out = train.apply_isotonic(train.fit_isotonic(df), df.where("score < 0.5")).select("score", "calibrated").distinct().collect()
    assert {round(r["score"] * 1e7): round(r["calibrated"], 9) for r in out} == {k: k / 20 for k in range(1, 21)}
    monkeypatch.setattr(train, "POOLED", 10)
    hot = [(0.5, i % 2) for i in range(3000)] + [(i / 1000, i % 2) for i in range(1000) if i != 500]
    groups = sorted(tuple(r) for r in train.score_groups(spark.createDataFrame(hot, "score double, label int").repartition(3)).collect())
    assert len(groups) <= 20 and sum(w for _, _, w in groups) == len(hot)
    assert max(w for _, _, w in groups if w < 3000) <= 101 and sum(w >= 3000 for _, _, w in groups) == 1


def test_grid_search_covers_the_references_axes(spark, monkeypatch):
    from cohortlens.operators import train
    from cohortlens.plans import q_ml
    asked = {}

    def search(df, features, kind, grid, label, k, **fixed):
        assert k == 5 and df.select("fold").distinct().count() == 5 and fixed["n_rows"] > 0
        asked[kind] = {a: {p[a] for p in grid} for a in grid[0]}
        assert len({str(p) for p in grid}) == len(grid) == np.prod([len(v) for v in asked[kind].values()])
        return [(p, 0.9 if kind == "logistic" else 0.5, 0.0) for p in grid]

    monkeypatch.setattr(train, "grid_search", search)
    out = q_ml._q_grid_learners(spark, "/root/testdata/sf0.001").collect()
    C = {0.1, 1.0, 10.0, 100.0}
    assert asked == {"svm_linear": {"C": C}, "svm_rbf": {"C": C, "gamma": {"scale", "auto", 0.01, 0.1}},
                     "random_forest": {"numTrees": {100, 200, 300}, "maxDepth": {10, 20, 30}, "minInstancesPerNode": {1, 2, 4}},
                     "gbt": {"maxIter": {100, 200, 300}, "stepSize": {0.01, 0.05, 0.1}, "maxDepth": {3, 5, 7, 9}}, "logistic": {"C": {0.1, 1.0, 10.0}}}
    assert len(out) == 86 and [r["model"] for r in out if r["chosen"]] == ["logistic"]


def test_grid_parameters_reach_the_learner(spark):
    from cohortlens.operators.train import cross_validate, make_learner, rbf_gamma
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (160, 2))
    rows = [(float(a), float(b), int(a * a + b * b > 6), i % 2) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, label int, fold int")
    assert rbf_gamma(df, ["a", "b"], "auto") == 0.5 and rbf_gamma(df, ["a", "b"], 0.1) == 0.1
    assert rbf_gamma(df, ["a", "b"], "scale") == pytest.approx(1 / (2 * x.var()))
    aucs = [cross_validate(df, ["a", "b"], "svm_rbf", k=2, C=1.0, gamma=g, n_rows=80)["mean_auc"] for g in ("scale", 1e-6)]
    assert aucs[0] > 0.9 and aucs[0] > aucs[1] + 0.01
    assert make_learner("random_forest", minInstancesPerNode=4).getMinInstancesPerNode() == 4
    assert make_learner("svm_linear", C=10.0, n_rows=100).getRegParam() == pytest.approx(0.001)


def test_isolation_forest_contamination(spark):
    from cohortlens.operators.multivariate import isolation_forest
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (950, 2)), rng.normal(8, 1, (50, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out = isolation_forest(df, ["a", "b"], "id", n_trees=30, contamination=0.05).toPandas()
    assert 0.02 <= out["is_outlier"].mean() <= 0.08
    assert out.loc[out["id"] >= 950, "is_outlier"].mean() > 0.5


def _brute_knn(x, ids, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out, d


def test_a_point_near_no_border_stays_in_its_cell():
    from cohortlens.operators import neighbours as NB
    x = np.random.default_rng(2).uniform(size=(60_000, 5))
    boxes = NB.Boxes(x[:800], 6)
    cell, _ = boxes.assign(x)
    assert boxes.cells == 6 and np.bincount(cell).min() > 5_000
    boxes.measured([{f"{n}{i}": f(x[cell == c, i]) for i in range(5) for n, f in (("low", np.min), ("high", np.max))} for c in range(6)], 5)
    copies = 0
    for c in range(6):
        own = x[cell == c]
        own = own[NB._runs(own)]
        bound = NB._kth(own, 20)
        near = boxes.may_hold(own, bound)
        copies += near.sum()
        assert near[:, c].all()
        far = ((own[:50, None, :] - x[None, ::1]) ** 2).sum(axis=-1)
        within = np.sqrt(far) <= bound[:50, None]
        assert (within.sum(axis=1) >= 21).all() and not (within & ~near[:50][:, cell]).any()
    assert copies < 3 * len(x)  # pivots of 1,024 rows sent about 60 copies


def test_equal_points_send_k_pairs_each():
    from cohortlens.operators import neighbours as NB
    x, ids = np.ones((1000, 3)), np.arange(1000)
    bound = NB._kth(x, 20)
    got = [np.concatenate(c) for c in zip(*NB._nearest(ids, x, bound, ids, x, 20))]
    assert len(got[0]) == 20_000 and got[1][got[0] == 500].tolist() == list(range(20)) and got[1][got[0] == 3].tolist() == [0, 1, 2, *range(4, 21)]


def test_knn_with_ties_and_one_heavy_point(spark):
    from cohortlens.operators.neighbours import knn
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, size=(600, 3)), np.full((500, 3), 2.0), rng.normal(size=(400, 3)) * 50]).astype(float)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    got = {(r["id"], r["nbr"], r["rank"]) for r in knn(df, "id", "v", 5, 120).collect()}
    assert got == _brute_knn(x, ids, 5)[0]


@pytest.mark.parametrize("block_rows", [1024, 40])
def test_knn_is_exact(spark, block_rows):
    from cohortlens.operators.neighbours import knn
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (120, 3)), rng.normal(6, 0.2, (150, 3)), np.tile([[2.0, 2.0, 2.0]], (30, 1))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)] + [(None, [1.0, 1.0, 1.0]), (999, None)],
                               "id long, v array<double>").repartition(4)
    got = {(r["id"], r["nbr"], r["rank"]) for r in knn(df, "id", "v", 5, block_rows).collect()}
    assert got == _brute_knn(x, ids, 5)[0]


def test_lof_against_brute_force(spark):
    from cohortlens.operators.neighbours import lof_outliers
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (190, 2)), rng.normal(9, 3, (10, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: (r["lof"], r["is_outlier"]) for r in lof_outliers(df, ["a", "b"], "id", 10, 0.05).collect()}
    nb, d = _brute_knn(x, np.arange(len(x)), 10)
    near = [[j for i, j, _ in nb if i == q] for q in range(len(x))]
    kd = np.array([max(d[q, n]) for q, n in enumerate(near)])
    lrd = np.array([1 / (np.mean([max(d[q, j], kd[j]) for j in n]) + 1e-10) for q, n in enumerate(near)])
    lof = np.array([lrd[n].mean() / lrd[q] for q, n in enumerate(near)])
    assert np.allclose([got[q][0] for q in range(len(x))], lof)
    assert sum(o for _, o in got.values()) == 10


def test_ensemble_flags_vote7(spark):
    """The seven-row fixture with two extreme rows: at least one row is flagged; a constant column is left out."""
    from cohortlens.plans.q_ml import ensemble_flags
    rows = [(i, float(a), float(b), float(c), 1.0) for i, (a, b, c) in enumerate(zip(
        (1, 2, 100, 3, 4, 5, 200), (5, 6, 7, 8, 9, 10, 100), range(10, 80, 10)))]
    df = spark.createDataFrame(rows, "id long, feature1 double, feature2 double, feature3 double, constant double")
    flags = ensemble_flags(df, ["feature1", "feature2", "feature3", "constant"], "id", 0.15).collect()
    assert len(flags) == 7 and any(r["mcd"] or r["lof"] or r["iforest"] for r in flags)


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    from cohortlens.plans.catalog import REGISTRY
    sf = "/root/testdata/sf0.001"
    st = REGISTRY["r1_scoring_stream_equals_batch"].run(spark, sf)
    from cohortlens.operators.outliers import fit_reference_stats
    from cohortlens.operators.split import train_test_split
    from cohortlens.plans import fixtures as FX
    from cohortlens.plans.q_io import STREAM_Z
    from cohortlens.plans.registry import round_doubles
    from cohortlens.streaming.score_stream import score_rows
    tr = train_test_split(FX.scored_encounters(spark, sf), "encounter_id").where("split = 'train'")
    stats = {r["column"]: (r["mean"], r["sd"]) for r in fit_reference_stats(tr, STREAM_Z).collect()}
    b = round_doubles(score_rows(FX.encounters(spark, sf), stats))
    assert st.exceptAll(b).count() == 0 and b.exceptAll(st).count() == 0


def test_sampled_shapley_uses_all_cores(spark, monkeypatch):
    """A table of one split is many tasks, more of them where there are more vectors, and gives the same values."""
    from pyspark.sql import functions as F
    from cohortlens.operators import explain
    df = spark.range(60, numPartitions=1).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    seen = []

    def score(frame):
        seen.append(frame.rdd.getNumPartitions())
        return frame.withColumn("score", 2 * F.col("a") - F.col("b") * F.col("a"))

    def values():
        return sorted(tuple(r) for r in explain.sampled_shapley(df, score, ["a", "b"], "id", df.limit(3), n_perm=3).collect())
    few = values()
    monkeypatch.setattr(explain, "TASK_VECTORS", 20)
    assert values() == few and len(few) == 120
    assert seen == [2 * spark.sparkContext.defaultParallelism, 27]  # 60 rows of 9 vectors, 20 a task


def test_sampled_shapley_additivity_linear(spark):
    """Permutation-sampling Shapley on a linear scorer equals w_j (x_j - z̄_j)
    when every permutation uses the same background row: check efficiency
    (Σφ = f(x) − E f(z)) row by row."""
    from pyspark.sql import functions as F
    from cohortlens.operators.explain import sampled_shapley
    rows = [(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    bg = spark.createDataFrame([(0, 1.0, 2.0, 0.5)], "id long, a double, b double, c double")

    def score(frame):
        return frame.withColumn("score", 0.5 * F.col("a") - 2.0 * F.col("b") + 3.0 * F.col("c"))
    phi = sampled_shapley(df, score, ["a", "b", "c"], "id", bg, n_perm=4).toPandas()
    tot = phi.groupby("id").agg(s=("contribution", "sum"), b=("base_value", "max"))
    exp = {i: 0.5 * a - 2.0 * b + 3.0 * c for i, a, b, c in rows}
    for i, r in tot.iterrows():
        assert abs(r["s"] + r["b"] - exp[i]) < 1e-9
    w = {"a": 0.5, "b": -2.0, "c": 3.0}
    z = {"a": 1.0, "b": 2.0, "c": 0.5}
    xs = {i: {"a": a, "b": b, "c": c} for i, a, b, c in rows}
    for _, r in phi.iterrows():
        assert abs(r["contribution"] - w[r["feature"]] * (xs[r["id"]][r["feature"]] - z[r["feature"]])) < 1e-9


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, 0.5, 300) > 0).astype(int)
    return spark.createDataFrame([(*map(float, r), int(c), i % 2) for i, (r, c) in enumerate(zip(x, y))], "a double, b double, c double, label int, fold int").coalesce(1).cache()


def test_staged_boosting_equals_separate_fits(spark, folds):
    from cohortlens.operators.train import cross_validate, grid_search
    grid = [{"maxIter": n, "stepSize": r, "maxDepth": 3} for n in (2, 4, 6) for r in (0.1, 0.3)]
    got = {str(p): (m, sd) for p, m, sd in grid_search(folds, ["a", "b", "c"], "gbt", grid, k=2, n_rows=150)}
    assert len(got) == 6
    for p in grid:
        one = cross_validate(folds, ["a", "b", "c"], "gbt", k=2, **p)
        assert got[str(p)] == pytest.approx((one["mean_auc"], one["std_auc"]), abs=1e-9)


def test_forest_parts(spark, folds):
    """The whole forest scores as Spark's own; its parts are forests of fewer trees or levels, read off by hand."""
    from cohortlens.operators import staged
    from cohortlens.operators.train import fit_model, grid_search, score
    feats = ["a", "b", "c"]
    model, _, _ = fit_model(folds, feats, "random_forest", numTrees=6, maxDepth=5)
    trees = staged.Trees(spark, model, False)
    rows = staged.scored(folds, feats, "label", trees, "random_forest", [[2, 6], [0, 2, 30]]).toPandas()
    own = score(model, folds, feats, "random_forest").toPandas()["score"]
    assert np.allclose(sorted(rows[rows["candidate"] == 5]["score"]), sorted(own))
    top = np.mean([trees.value[i] for i in trees.first[:2]])  # two trees, roots alone
    assert np.allclose(rows[rows["candidate"] == 0]["score"], top)
    assert rows[rows["candidate"] == 1]["score"].nunique() <= 16
    grid = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n in (2, 4) for d in (2, 5) for m in (1, 3)]
    out = grid_search(folds, feats, "random_forest", grid, k=2, n_rows=150)
    assert [p for p, _, _ in out] != [] and {str(p) for p, _, _ in out} == {str(p) for p in grid} and all(0.5 < m <= 1 for _, m, _ in out)
    assert [len(g[2]) for g in staged.groups("random_forest", grid)] == [4, 4]


def test_column_forests_equal_walked_trees(spark):
    from cohortlens.operators import multivariate as MV
    rng = np.random.default_rng(12)
    x = np.column_stack([np.concatenate([rng.normal(0, 1, 570), [9.0] * 30]), rng.integers(0, 5, 600)]).astype(float)
    df = spark.createDataFrame([(i, None if i % 20 == 7 else float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(3)
    out = MV.column_forests(df, ["a", "b"], "id", n_trees=20, contamination=0.1).collect()
    grown = MV._grow_forests(df, {c: [F.col(c)] for c in ("a", "b")}, "id", 20, 256, 42)
    for c in ("a", "b"):
        psi, trees = grown[c]
        known = [r for r in out if r[c] is not None]
        score = 2.0 ** (-MV._path_lengths(trees, np.array([[r[c]] for r in known])) / len(trees) / MV._c(psi))
        cut = np.quantile(score, 0.9)
        assert [r[f"{c}__outlier"] for r in known] == (score > cut).tolist()
    assert {r["a__outlier"] for r in out if r["a"] is None} == {None}
    far = [r["a__outlier"] for r in out if r["a"] == 9.0]
    assert np.mean(far) > 0.9


def test_equal_prefixes_are_scored_once(spark):
    """A feature with the background's value changes nothing and adds 0: its vector is not scored again."""
    from cohortlens.operators.explain import sampled_shapley
    df = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in range(10)], "id long, a double, b double, c double")
    sizes = []

    def score(frame):
        frame = frame.cache()
        sizes.append(frame.count())
        return frame.withColumn("score", F.col("a") * 2 + F.col("b") - F.col("c"))

    phi = {(r["id"], r["feature"]): r["contribution"] for r in sampled_shapley(df, score, ["a", "b", "c"], "id", df.limit(1), n_perm=3).collect()}
    assert sizes[0] <= 10 * 3 * 2
    assert all(abs(phi[i, "b"]) < 1e-12 and abs(phi[i, "c"]) < 1e-12 for i in range(10))
    zero = df.first()["a"]
    assert all(abs(phi[i, "a"] - 2 * (i - zero)) < 1e-9 for i in range(10))


def test_correlations_by_products_equal_the_aggregate(spark):
    from cohortlens.operators.profile import corr_pairs
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + [1e4, 0, -5]
    rows = [(*(None if rng.random() < 0.1 else float(v) for v in r), 3.7, None) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, none double").repartition(4)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_pairs(df, df.columns).collect()}
    assert len(got) == 10 and all(v is None for (a, b), v in got.items() if {a, b} & {"same", "none"})
    for a, b in [("a", "b"), ("a", "c"), ("b", "c")]:
        assert got[a, b] == pytest.approx(df.select(F.corr(a, b)).first()[0], abs=1e-11)
    plan = corr_pairs(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "corr(" not in plan  # one buffer set a pair made an aggregate of hundreds of columns


def _events(spark, path, n=400):
    """An events table of own rows."""
    rows = spark.range(n).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 7 as user_id", "'web' as event_type",
                                     "cast(id * 31 % 101 as double) as value", "'{}' as props")
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_iterative_fits_read_written_columns(spark, tmp_path, monkeypatch):
    """the fits' rows are a Parquet table, their folds a stored column: no pass hashes ids or reads a checkpoint of whole rows."""
    from cohortlens.operators import train as TR
    from cohortlens.plans import q_ml
    d = _events(spark, tmp_path)
    plan = q_ml._standardized(spark, d).select("label")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [label" in plan and "ExistingRDD" not in plan
    seen = []
    monkeypatch.setattr(TR, "grid_search", lambda t, *a, **k: seen.append(t._jdf.queryExecution().optimizedPlan().toString()) or [({}, 0.5, 0.0)])
    monkeypatch.setattr(TR, "platt_kfold", lambda t, *a, **k: seen.append(t._jdf.queryExecution().optimizedPlan().toString()) or (lambda rows, i: rows.selectExpr("*", "0.5D as calibrated")))
    q_ml._q_grid(spark, d), q_ml._q_grid_f1(spark, d), q_ml._q_platt_kfold(spark, d)
    assert len(seen) == 3 and all("md5" not in p for p in seen)


def test_folds_are_judged_together(spark):
    """one ranking for all folds gives each fold's own AUC and F1."""
    import numpy as np
    from cohortlens.operators import metrics as ME
    from cohortlens.operators import train as TR
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 300)
    df = spark.createDataFrame([(float(a), int(a + b > 0), i % 3) for i, (a, b) in enumerate(zip(x, r.normal(0, 1, 300)))], "x double, label int, fold int").coalesce(1).cache()
    for scoring in ("auc", "f1"):
        cv = TR.cross_validate(df, ["x"], "logistic", k=3, scoring=scoring)
        for f in range(3):
            m = TR.fit_model(df.where(f"fold <> {f}"), ["x"], "logistic")[0]
            sc = TR.score(m, df.where(f"fold = {f}"), ["x"], "logistic")
            want = ME.auc(sc).first()["auc"] if scoring == "auc" else ME.with_rates(ME.confusion(sc)).first()["f1"]
            assert abs(cv["fold_auc"][f] - want) < 1e-12


def test_kfold_platt_scores_rows_in_one_pass(spark):
    """the mean of the members' calibrated chances, without a copy of the rows a member; repeated and null ids as a join keeps them."""
    import numpy as np
    from cohortlens.operators import train as TR
    r = np.random.default_rng(2)
    x = r.normal(0, 1, 300)
    df = spark.createDataFrame([(i, float(a), int(a + b > 0), i % 3) for i, (a, b) in enumerate(zip(x, r.normal(0, 1, 300)))], "id int, x double, label int, fold int").coalesce(1).cache()
    asked = spark.createDataFrame([(1, 0.5), (1, -0.5), (2, 0.1), (None, 0.3)], "id int, x double")
    out = TR.platt_kfold(df, ["x"], "logistic")(asked, "id")
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    chance = {0.5: [], -0.5: [], 0.1: []}
    for f in range(3):
        m = TR.fit_model(df.where(f"fold <> {f}"), ["x"], "logistic")[0]
        a, b = TR.fit_platt(TR.score(m, df.where(f"fold = {f}"), ["x"], "logistic"))
        for row in TR.apply_platt(TR.score(m, asked.where("id is not null"), ["x"], "logistic"), a, b).collect():
            chance[row["x"]].append(row["calibrated"])
    got = {(g["id"], g["x"]): g["calibrated"] for g in out.collect()}
    both = np.mean(chance[0.5] + chance[-0.5])
    assert set(got) == {(1, 0.5), (1, -0.5), (2, 0.1)}
    assert abs(got[1, 0.5] - both) < 1e-9 and abs(got[1, -0.5] - both) < 1e-9 and abs(got[2, 0.1] - np.mean(chance[0.1])) < 1e-9


@pytest.mark.parametrize("query", ["m01_m05_model_comparison", "m23_efficiency"])
def test_compared_models_score_a_row_once(spark, monkeypatch, query):
    """Counts and ranks read written scores: no plan that is evaluated holds the model."""
    from cohortlens.plans import q_ml
    from cohortlens.plans.catalog import REGISTRY
    plans, evaluate = [], q_ml.ME.evaluate

    def seen(df, *a, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return evaluate(df, *a, **kw)
    monkeypatch.setattr(q_ml.ME, "evaluate", seen)
    monkeypatch.setattr(q_ml, "KINDS", ["logistic", "svm_linear"])
    monkeypatch.setattr(q_ml, "REGISTERED", [("standard_lr", "logistic", False), ("calibrated_lr", "logistic", True)])
    rows = REGISTRY[query].run(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 and all(0 < r["auc"] <= 1 for r in rows)
    assert len(plans) == 2 and not any("UDF" in p or "Join" in p for p in plans)
