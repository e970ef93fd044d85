"""The reference's own test tables and expected values."""

import math

import pytest
from pyspark.sql import functions as F

IMPUTE6 = [
    (5.0, 0, 24.0, 1, 15.0, 80.0, 50.0, 1),
    (10.0, 1, 48.0, 0, 8.5, 65.0, 15.0, 0),
    (15.0, 0, 12.0, 1, 22.0, 85.0, 100.0, 1),
    (8.0, 1, 36.0, 1, 10.5, 75.0, 25.0, 0),
    (12.0, 0, 72.0, 0, None, 60.0, 10.0, 0),
    (None, 1, 8.0, 0, 9.0, None, 5.0, 0),
]
SCHEMA6 = ("age double, gender int, duration double, fever int, white_blood_cell_count double, "
           "neutrophil_percentage double, c_reactive_protein double, appendicitis int")


@pytest.fixture
def impute6(spark):
    return spark.createDataFrame(IMPUTE6, SCHEMA6).withColumn("rid", F.monotonically_increasing_id())


def test_median_impute(impute6):
    from cohortlens.operators.missing import fit_imputer, apply_imputer
    p = fit_imputer(impute6, "median", exclude=["rid", "appendicitis"])
    assert p["fills"]["age"] == pytest.approx(10.0)
    assert p["fills"]["white_blood_cell_count"] == pytest.approx(10.5)
    assert p["fills"]["neutrophil_percentage"] == pytest.approx(75.0)
    out = apply_imputer(impute6, p)
    assert sum(out.agg(*[F.count_if(F.col(c).isNull()) for c in out.columns]).collect()[0]) == 0


def test_mean_impute(impute6):
    from cohortlens.operators.missing import fit_imputer
    p = fit_imputer(impute6, "mean", exclude=["rid"])
    assert p["fills"]["age"] == pytest.approx((5 + 10 + 15 + 8 + 12) / 5)


def test_iqr_cap_lowers_max(spark):
    from cohortlens.operators.outliers import handle_outliers
    rows = IMPUTE6 + [(10.0, 1, 500.0, 1, 50.0, 99.0, 300.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA6)
    out, st = handle_outliers(df, ["duration", "c_reactive_protein"], "iqr", "cap")
    mx = out.agg(F.max("duration"), F.max("c_reactive_protein")).collect()[0]
    assert mx[0] < 500.0 and mx[1] < 300.0
    stats = {r["column"]: r["n_outliers"] for r in st.collect()}
    assert stats["duration"] >= 1 and stats["c_reactive_protein"] >= 1


def test_vote7_flags_something(spark):
    from cohortlens.operators.multivariate import robust_mahalanobis
    rows = [tuple(float(v) for v in r) for r in zip([1, 2, 100, 3, 4, 5, 200], [5, 6, 7, 8, 9, 10, 100], [10, 20, 30, 40, 50, 60, 70])]
    df = spark.createDataFrame(rows, "feature1 double, feature2 double, feature3 double")
    out, _ = robust_mahalanobis(df, ["feature1", "feature2", "feature3"], contamination=0.15)
    assert out.where("is_outlier").count() >= 1


def test_narrow5_duplicate_and_sparse(spark):
    from cohortlens.operators.narrow import narrowing_plan
    from cohortlens.operators.profile import duplicate_columns
    rows = [(10, 10, 0, 1000, "A", i) for i in range(1)]
    data = [(10, 10, 0, 1000, "A", 0), (20, 20, 0, 2000, "B", 1), (30, 30, 0, 3000, "A", 2),
            (40, 40, 10, 4000, "C", 3), (50, 50, 0, 5000, "B", 4)]
    df = spark.createDataFrame(data, "age long, age_copy long, sparse_col long, large_int long, category_col string, rid long")
    d = duplicate_columns(df, ["age", "age_copy", "sparse_col", "large_int"], "rid").collect()
    assert [(r["column"], r["duplicate_of"]) for r in d] == [("age_copy", "age")]
    plan = {r["column"]: r for r in narrowing_plan(df.drop("rid")).collect()}
    assert plan["age"]["new_type"] == "uint8" and plan["large_int"]["new_type"] == "uint16"
    assert plan["sparse_col"]["sparse_candidate"] is True
    assert plan["category_col"]["new_type"] == "object"        # 3/5 distinct is not < .5


def test_derive3(spark):
    from cohortlens.operators.features import clinical_features
    rows = [
        (5.0, 0, 6.0, 0, 1, 1, 0, 1, 0, 0, 8.0, 60.0, 10.0, 5),
        (10.0, 1, 24.0, 1, 1, 0, 1, 1, 1, 1, 15.0, 85.0, 40.0, 8),
        (15.0, 0, 48.0, 1, 0, 1, 1, 1, 1, 1, 20.0, 90.0, 100.0, 9),
    ]
    schema = ("age double, gender int, duration_of_pain double, migration int, anorexia int, nausea int, vomiting int, "
              "right_lower_quadrant_pain int, fever int, rebound_tenderness int, white_blood_cell_count double, "
              "neutrophil_percentage double, c_reactive_protein double, alvarado_score int")
    df = spark.createDataFrame(rows, schema).withColumn("i", F.monotonically_increasing_id())
    out = clinical_features(df).orderBy("i").collect()
    assert [r["symptom_count"] for r in out] == [3, 6, 6]
    assert [r["absolute_neutrophils"] for r in out] == pytest.approx([4.8, 12.75, 18.0])
    assert [r["classic_triad"] for r in out] == [0, 1, 1]
    assert [round(r["lab_composite_score"], 2) for r in out] == pytest.approx([0.36, 0.64, 0.87], abs=0.006)
    assert [r["alvarado_risk"] for r in out] == [1, 2, 2]
    assert [r["age"] for r in out] == [5.0, 10.0, 15.0]         # originals unchanged


def test_risk_classes(spark):
    from cohortlens.functions.scalar import risk_band
    df = spark.createDataFrame([(0.05,), (0.3,), (0.75,), (None,)], "p double")
    got = [r[0] for r in df.select(risk_band("p", "app")).collect()]
    assert got == ["Low Risk", "Moderate Risk", "High Risk", None]
