"""Distributed ordering primitives against numpy/pandas brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F


def test_running_sum_matches_cumsum(spark):
    from cohortlens.functions.ordering import running_sum
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, 500)
    v = rng.normal(size=500)
    w = rng.integers(1, 5, 500)
    pdf = pd.DataFrame({"g": g, "v": v, "w": w}).drop_duplicates(["g", "v"])
    df = spark.createDataFrame(pdf)
    got = running_sum(df, "v", "w", ["g"]).toPandas().sort_values(["g", "v"])
    exp = pdf.sort_values(["g", "v"]).groupby("g")["w"].cumsum()
    assert got["cum_w"].tolist() == exp.tolist()


def test_running_sum_descending(spark):
    from cohortlens.functions.ordering import running_sum
    pdf = pd.DataFrame({"v": np.arange(100.0), "w": np.ones(100)})
    got = running_sum(spark.createDataFrame(pdf), "v", "w", descending=True).toPandas().sort_values("v")
    assert got["cum_w"].tolist() == list(np.arange(100, 0, -1.0))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=60))
def test_exact_quantiles_match_numpy(spark, xs):
    from cohortlens.functions.ordering import exact_quantiles
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], probs, buckets=8).collect()}
    for p in probs:
        assert q[p] == pytest.approx(float(np.quantile(xs, p)), rel=1e-9, abs=1e-9)


def test_distributed_quantiles_with_ties_and_nulls(spark):
    from cohortlens.functions.ordering import exact_quantiles
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50, 20000).astype(float)
    b = np.where(rng.random(20000) < 0.1, np.nan, rng.normal(size=20000))
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf).selectExpr("a", "CASE WHEN isnan(b) THEN NULL ELSE b END AS b")
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probs).collect()}
    for p in probs:
        assert got[("a", p)] == pytest.approx(np.quantile(a, p))
        assert got[("b", p)] == pytest.approx(np.quantile(b[~np.isnan(b)], p))


def test_global_row_number_is_permutation(spark):
    from cohortlens.functions.ordering import global_row_number, hash_key
    df = spark.range(1000).withColumn("h", hash_key("id"))
    r = global_row_number(df, ["h", "id"]).toPandas()
    assert sorted(r["rn"]) == list(range(1, 1001))
    assert (r.sort_values("h")["rn"].to_numpy() == np.arange(1, 1001)).all()


def test_dbscan_noise_matches_brute_force(spark):
    from cohortlens.operators.outliers import dbscan_noise_values
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 200), [8.0, 9.5, -7.0]]).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = dbscan_noise_values(df, ["x"]).toPandas()
    n_noise = int(got.loc[got["noise"], "cnt"].sum())
    z = (x - x.mean()) / x.std()
    nb = np.array([(np.abs(z - zi) <= 0.5).sum() for zi in z])
    core = nb >= 5
    noise = [(not core[i]) and not core[np.abs(z - z[i]) <= 0.5].any() for i in range(len(z))]
    assert n_noise == sum(noise)


def test_dbscan_flags_by_ranges_match_brute_force(spark):
    """Rows are flagged by ranges of noise values: no join, nulls are no outliers, a constant column has none, repeated values count once a row."""
    from cohortlens.operators.outliers import dbscan_noise_ranges, handle_outliers_model
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(20, 1, 150), [8.0, 8.0, 9.5, -17.0, 40.0, 12.0]]).round(2)
    rows = [(i, float(v), 1.0) for i, v in enumerate(x)] + [(1000 + i, None, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, flat double").repartition(3)
    z = (x - x.mean()) / x.std()
    core = np.array([(np.abs(z - v) <= 0.5).sum() for v in z]) >= 5
    noise = np.array([not core[i] and not core[np.abs(z - z[i]) <= 0.5].any() for i in range(len(z))])
    assert 0 < noise.sum() < 10
    ranges = dbscan_noise_ranges(df, ["x", "flat"])
    assert set(ranges) == {"x"} and len(ranges["x"]) == 1 + (np.diff(np.flatnonzero(noise[np.argsort(z)])) > 1).sum()
    kept, stats = handle_outliers_model(df, ["x", "flat"], "dbscan", "id", "remove")
    assert {r["id"] for r in kept.collect()} == {r[0] for r in rows} - set(np.flatnonzero(noise).tolist())
    got = {r["column"]: r["n_outliers"] for r in stats.collect()}
    assert got["x"] == noise.sum()
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_of_short_and_long_values(spark):
    from cohortlens.operators.narrow import narrowing_plan
    rows = [("k" * 200 + str(i % 3), f"v{i}", None) for i in range(10)]
    df = spark.createDataFrame(rows, "long_text string, own string, nothing string")
    plan = {r["column"]: r["new_type"] for r in narrowing_plan(df).collect()}
    assert plan == {"long_text": "category", "own": "object", "nothing": "category"}


def test_running_sum_keeps_null_keys(spark):
    from cohortlens.functions.ordering import running_sum
    rng = np.random.default_rng(11)
    rows = [(None if g == 3 else int(g), float(v), int(w)) for g, v, w in zip(rng.integers(0, 4, 3000), rng.normal(size=3000), rng.integers(1, 9, 3000))]
    got = running_sum(spark.createDataFrame(rows, "g int, v double, w int").repartition(5), "v", "w", ["g"], descending=True).collect()
    assert len(got) == len(rows)
    for g in (None, 0, 1, 2):
        own = sorted((r["v"], r["cum_w"]) for r in got if r["g"] == g)
        expected = np.cumsum([w for k, v, w in sorted(rows, key=lambda r: -r[1]) if k == g])
        assert [c for _, c in reversed(own)] == expected.tolist()


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_cutoffs_are_exact(spark, monkeypatch, n):
    from cohortlens.functions.ordering import hash_key
    from cohortlens.operators import split
    monkeypatch.setattr(split, "READ_ROWS", 3)          # force finer prefixes
    df = spark.range(n).withColumn("label", (F.col("id") % 7 == 0).cast("int")).withColumn("h", hash_key("id"))
    rows = sorted((r["h"], r["id"], r["label"]) for r in df.collect())
    whole = {r["id"]: r["split"] for r in split.train_test_split(df, "id").collect()}
    assert [i for _, i, _ in rows if whole[i] == "test"] == [i for _, i, _ in rows][:int(np.ceil(n * 0.2))]
    by = {r["id"]: r["split"] for r in split.train_test_split(df, "id", 0.3, stratify="label").collect()}
    for lab in (0, 1):
        own = [i for _, i, k in rows if k == lab]
        assert [i for i in own if by[i] == "test"] == own[:int(np.ceil(len(own) * 0.3))]
    folds = [r["fold"] for r in split.kfold(df, "id", 5).collect()]
    assert len(folds) == n and (n < 5 or max(folds.count(f) for f in range(5)) - min(folds.count(f) for f in range(5)) <= 1)


def test_quantile_range_refinement(spark):
    """Force refinement rounds (tiny refine_limit, few buckets) and compare
    with numpy, including ties and a hot value holding a third of rows."""
    from cohortlens.functions.ordering import exact_quantiles
    rng = np.random.default_rng(21)
    a = np.concatenate([np.full(4000, 7.0), rng.normal(size=8000).round(3)])
    df = spark.createDataFrame([(float(v),) for v in a], "a double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in
           exact_quantiles(df, ["a"], probs, buckets=4, refine_limit=50).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(a, p))


def test_quantiles_keep_digits_and_infinities(spark):
    import datetime as dt
    from decimal import Decimal

    import numpy as np
    from cohortlens.functions.ordering import exact_quantiles
    inf, n = float("inf"), 40
    rows = [(2 ** 53 + i, Decimal(i) + Decimal("0.000000000000000001"), inf if i % 4 == 0 else -inf if i % 4 == 1 else float("nan") if i % 4 == 2 else float(i),
             dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=i)) for i in range(n)]
    df = spark.createDataFrame(rows, "a bigint, b decimal(38,18), c double, t timestamp").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r for r in exact_quantiles(df, ["a", "b", "c", "t"], probs, buckets=4, refine_limit=5, neighbours=True).collect()}
    finite = sorted(x for _, _, x, _ in rows if x == x)
    for p in probs:
        low, high = int(np.floor((n - 1) * p)), int(np.ceil((n - 1) * p))
        for c, k in (("a", 0), ("b", 1)):
            assert (got[c, p]["low"], got[c, p]["high"]) == (rows[low][k], rows[high][k])
        assert got["t", p]["high"] - got["t", p]["low"] == high - low
        x, y = finite[int(np.floor((len(finite) - 1) * p))], finite[int(np.ceil((len(finite) - 1) * p))]
        assert got["c", p]["low"] is None
        assert got["c", p]["value"] == (x if x == y else x + (y - x) * ((len(finite) - 1) * p % 1)) or abs(got["c", p]["value"]) == inf
    assert got["c", 1.0]["value"] == inf and got["c", 0.0]["value"] == -inf


def test_quantile_ranges_are_scanned_column_by_column(spark):
    """the last step reads one column at a time and stacks none; nulls, infinities, ties and repeated values as before."""
    import numpy as np
    from cohortlens.functions.ordering import exact_quantiles
    r = np.random.default_rng(3)
    a, b = r.normal(0, 1, 5000).round(2), r.integers(0, 2, 5000)
    rows = [(None if i % 7 == 0 else float(x), int(y), float("inf") if i % 3 == 0 else -1.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(3)
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.9])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Relation [") == 3  # the one explode is of the target positions
    found = {(x["column"], x["prob"]): x["value"] for x in got.collect()}
    for name, values in (("a", [x[0] for x in rows if x[0] is not None]), ("b", b.astype(float))):
        for p in (0.25, 0.5, 0.9):
            assert abs(found[name, p] - np.quantile(values, p)) < 1e-12
    assert [found["c", p] for p in (0.25, 0.5, 0.9)] == [-1.0, -1.0, float("inf")]
