import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cohortlens.operators import calibrated as C
from cohortlens.sources import files as FI
from cohortlens.sources.registry import save_model
from cohortlens.streaming import feedback_stream as FB
from cohortlens.streaming import model_stream as MS


def reports(rows):
    return [{"report_id": i, "prediction_class": c, "actual_diagnosis": a, "timestamp": t} for i, c, a, t in rows]


def test_day_table_after_each_batch(spark, tmp_path):
    """Changed, late, repeated and older versions, and reports without a day."""
    waves = [
        [("1", "Élevé", "appendicite", "2024-01-01 10:00:00"), ("2", "Faible", "appendicite", "2024-01-01 11:00:00"), ("3", "Faible", "autre", "2024-01-02 09:00:00"),
         ("4", None, None, None), ("1", "Élevé", "non_appendicite", "2024-01-01 10:30:00")],
        [("2", "Faible", "non_appendicite", "2024-01-03 08:00:00"), ("5", "Élevé", "appendicite", "2023-12-01 00:00:00"), ("3", "Faible", "appendicite", "2024-01-01 00:00:00"),
         ("1", "Élevé", "non_appendicite", "2024-01-01 10:30:00")],
        [("2", "Faible", "non_appendicite", "2024-01-03 09:00:00")],
    ]
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    seen = []
    for k, wave in enumerate(waves):
        rows = spark.createDataFrame(reports(wave), "report_id string, prediction_class string, actual_diagnosis string, timestamp string")
        rows.coalesce(1).write.mode("append").json(src)
        seen.append(rows.withColumn("arrived", F.lit(k)).withColumn("event_time", F.to_timestamp("timestamp")))
        FB.start_concordance_stream(spark, src, FI.FEEDBACK_SCHEMA, sink, ck, multi_line=False).awaitTermination()
        every = seen[0]
        for more in seen[1:]:
            every = every.unionByName(more)
        want = sorted((tuple(r) for r in FB.daily_concordance(every).collect()), key=str)
        assert sorted((tuple(r) for r in FB.day_table(spark, sink).collect()), key=str) == want
    # the batches hold what changed, not the history
    def batch(n):
        return sorted(tuple(r) for r in spark.read.parquet(f"{sink}/batch={n}").collect())
    assert batch(1) == [("2023-12-01", "Vrai Positif", 1), ("2024-01-01", "Faux Négatif", -1), ("2024-01-03", "Vrai Négatif", 1)]
    assert batch(2) == []
    assert sorted(FB.day_table(spark, FB.compact(spark, sink)).collect(), key=str) == sorted(FB.day_table(spark, sink).collect(), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (400, 2))
    y = (x @ [1.5, -1.0] + r.logistic(size=400) > 0).astype(int)
    return spark.createDataFrame([(i, float(a) if i % 11 else None, float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "id long, a double, b double, label int").repartition(2).cache()


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibrated_pipeline_survives_saving(spark, rows, tmp_path, method):
    hold = rows.where("id % 3 = 0")
    model = C.serving_pipeline(rows.where("id % 3 <> 0"), ["a", "b"], "logistic", "label", C.medians(rows, ["a", "b"]), hold, method)
    model.write().save(str(tmp_path / method))
    loaded = PipelineModel.load(str(tmp_path / method))
    before, after = ({r["id"]: r["score"] for r in C.serve(m, rows).collect()} for m in (model, loaded))
    assert before == after and all(0 <= s <= 1 for s in after.values())
    plain = {r["id"]: r["score"] for r in C.serve(PipelineModel(model.stages[:3]), rows).collect()}
    assert plain != after
    order = sorted(plain, key=plain.get)
    assert all(after[x] <= after[y] + 1e-12 for x, y in zip(order, order[1:]))


def test_isotonic_step_equals_sparks_own(spark):
    from cohortlens.operators.train import apply_isotonic, fit_isotonic
    r = np.random.default_rng(2)
    s = r.random(300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, r.random(300) < s)], "score double, label int")
    made = fit_isotonic(df)
    step = C.IsotonicCalibrator(inputCol="score", outputCol="mine", boundaries=[float(x) for x in made.boundaries], values=[float(x) for x in made.predictions])
    asked = spark.createDataFrame([(x,) for x in [-1.0, 0.0, 0.123, 0.5, 0.999, 2.0, *map(float, s[:50])]], "score double")
    both = step.transform(apply_isotonic(made, asked)).collect()
    assert np.allclose([r["mine"] for r in both], [r["calibrated"] for r in both])


def test_model_changes_between_batches_and_stays_in_a_rerun(spark, rows, tmp_path):
    root, src, sink, ck = (str(tmp_path / n) for n in ("root", "src", "sink", "ck"))
    fills = C.medians(rows, ["a", "b"])
    models = {}
    for k, n_rows in enumerate((10, 1)):
        models[k] = C.serving_pipeline(rows, ["a", "b"], "logistic", "label", fills, n_rows=n_rows)
        save_model(spark, models[k], root, "standard_lr", "logistic", {}, dt.datetime(2024, 1, 1 + k))
        if k == 1:  # a batch that failed after noting its model runs again, with that model
            first = spark.read.schema(MS.NOTE).parquet(f"{sink}/models/batch_0").first()
            spark.createDataFrame([(1, *first[1:])], MS.NOTE).write.parquet(f"{sink}/models/batch_1")
        rows.where(F.col("id") % 3 == k).write.mode("append").parquet(src)
        MS.start_model_stream(spark, src, rows.schema, root, sink, ck).awaitTermination()
    rows.where("id % 3 = 2").write.mode("append").parquet(src)
    MS.start_model_stream(spark, src, rows.schema, root, sink, ck).awaitTermination()
    got = MS.scored_rows(spark, sink).collect()
    assert sorted(r["id"] for r in got) == list(range(400))
    assert {(r["batch"], r["version"]) for r in got} == {(0, "20240101_000000"), (1, "20240101_000000"), (2, "20240102_000000")}
    for k, m in ((0, 0), (1, 0), (2, 1)):
        want = {r["id"]: r["score"] for r in C.serve(models[m], rows).collect()}
        assert all(abs(r["score"] - want[r["id"]]) < 1e-12 for r in got if r["batch"] == k)


def test_one_call_keeps_many_reports():
    """F16: the state's key is a bucket of reports; of each report the last version counts, and the changes come folded."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def wave(*rows):
        return [pd.DataFrame([(*r[:3], "", "", *r[3:]) for r in rows], columns=list(FB.COLUMNS))]

    def run(frames):
        return {(d, c): n for f in FB._latest((0,), iter(frames), state) for d, c, n in f.itertuples(index=False)}

    state = State()
    assert run(wave(("1", 5, 1, "d1", "x"), ("2", 5, 1, "d1", "x"), ("1", 4, 1, "d0", "y"), ("3", 1, 1, None, "z"))) == {("d1", "x"): 2, (None, "z"): 1}
    assert run(wave(("2", 6, 2, "d2", "x"), ("3", 0, 9, "d9", "x"), ("4", 1, 2, "d1", "x"))) == {("d2", "x"): 1}
    assert run(wave(("2", 6, 2, "d2", "x"))) == {}


def test_state_is_keyed_by_bucket(spark):
    rows = spark.range(2).selectExpr("cast(id as string) as report_id", "timestamp'2024-01-01' as event_time", "timestamp'2024-01-02' as arrived",
                                          "'Faible' as prediction_class", "'autre' as actual_diagnosis")
    plan = FB.changes(rows)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan.split("FlatMapGroupsInPandasWithState")[1].split("[day")[0]
