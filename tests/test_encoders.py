import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import encode as EN


def log_likelihood(x, lam):
    y = np.where(x >= 0, np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam,
                 -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-12 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam))
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_lambda_by_brute_search(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.lognormal(0, 0.8, 500), rng.normal(0, 1, 500), -rng.gamma(2, 1, 500), np.full(500, 3.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 4], "a double, b double, c double, d double").repartition(3)
    found = EN.search_yeo_johnson(df, ["a", "b", "c", "d"])
    assert found["d"] == 1.0
    for k, c in enumerate("abc"):
        low, high = -2.0, 2.0
        for _ in range(80):  # golden section
            m1, m2 = high - (high - low) * 0.6180339887498949, low + (high - low) * 0.6180339887498949
            low, high = (low, m2) if log_likelihood(x[:, k], m1) >= log_likelihood(x[:, k], m2) else (m1, high)
        assert found[c] == pytest.approx((low + high) / 2, abs=1e-6)
    out = EN.apply_power(df, EN.fit_power(df, ["a", "b", "c"])).select("a", "b", "c").na.drop().toPandas()
    assert np.allclose(out.mean(), 0, atol=1e-9) and np.allclose(out.std(ddof=0), 1)


def test_sparse_one_hot_of_very_many_levels(spark):
    n = 50_000
    df = spark.range(n).select("id", F.concat(F.lit("k"), F.col("id") % 30_000).alias("many"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("few"))
    known = EN.level_dictionary(df.where("id < 29000"), ["many", "few"])
    assert known.count() == 29_001 and known.agg(F.min("index"), F.max("index"), F.countDistinct("index")).first()[:] == (0, 29_000, 29_001)
    rows = {r["id"]: r["indices"] for r in EN.sparse_one_hot(df, ["many", "few"], known).where("id IN (0, 1, 29500, 30000, 30001)").collect()}
    order = {f"k{i}": p for p, i in enumerate(sorted(range(29_000), key=lambda i: f"k{i}"))}
    assert rows == {0: [order["k0"]], 1: [order["k1"], 29_000], 29500: [29_000], 30000: [order["k0"]], 30001: [order["k1"], 29_000]}


def test_sparse_equals_dense_with_a_level_dropped(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "c", "x"), (5, "new", "z")], "id long, p string, q string")
    fit = df.where("id < 5")
    dense = EN.one_hot(df, EN.fit_levels(fit, ["p", "q"]), drop_first=True)
    names = [c for c in dense.columns if c != "id"]
    want = {r["id"]: [i for i, c in enumerate(names) if r[c]] for r in dense.collect()}
    got = EN.sparse_one_hot(df, ["p", "q"], EN.level_dictionary(fit, ["p", "q"], drop_first=True))
    assert {r["id"]: r["indices"] for r in got.collect()} == want


def test_dtype_histogram_and_target_guess(spark):
    from cohortlens.operators.profile import dtype_histogram
    df = spark.createDataFrame([(1, 2.0, "a", 0), (2, 3.0, "b", 1)], "id int, x double, name string, outcome int")
    counts = dtype_histogram(df)
    counts = {tuple(r) for r in counts.collect()} if hasattr(counts, "collect") else set(counts.items())
    assert {n for _, n in counts} == {1, 2} and sum(n for _, n in counts) == 4
    assert EN.guess_target(df) is not None


def test_power_search_takes_each_place_once_in_one_pass(spark, monkeypatch):
    import numpy as np
    x = [*np.random.default_rng(5).lognormal(1.0, 0.7, 400).tolist(), *np.random.default_rng(6).normal(0, 2, 200).tolist(), None]
    df = spark.createDataFrame([(v, 2.0) for v in x], "a double, same double").repartition(3)
    asked, sums = [], EN._power_sums
    monkeypatch.setattr(EN, "_power_sums", lambda data, places, centres: asked.append(places) or sums(data, places, centres))
    EN.search_yeo_johnson(df, ["a", "same"])
    each = [lam for places in asked for lam in places["a"]]
    assert len(each) == len(set(each)) and all(list(p) == ["a"] for p in asked)
    lams = [-2.0, -0.3, 0.0, 1.0, 1.7, 2.0]
    got = sums(df, {"a": lams}, {"a": 2.5})
    for lam in lams:
        want = df.select(F.var_pop(EN._yj(F.col("a"), lam))).first()[0]
        assert abs(got["a", lam] - want) <= 1e-9 * want
