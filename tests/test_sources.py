"""Feedback files as the entry form saves them, and table helpers."""

import json

import pytest


def report(i, **more):
    return {"report_id": f"r-{i}", "prediction_class": "Élevé", "prediction_probability": "0.87", "diagnostic_accuracy": "4",
            "actual_diagnosis": "appendicite", "other_diagnosis": "", "usefulness_rating": "5", "comments": "ok",
            "timestamp": f"2024-03-0{i} 10:00:00", "patient_data": {"age": 9.5, "gender": 1}} | more


def save(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=4, ensure_ascii=False))


def test_feedback_files_one_indented_object_each(spark, tmp_path):
    from cohortlens.sources.files import read_feedback_json
    src = tmp_path / "feedback"
    for i in (1, 2):
        save(src, f"feedback_{i}.json", report(i))
    save(src, "feedback_3.json", '{\n    "report_id": not json')
    good, bad = read_feedback_json(spark, str(src), str(tmp_path / "corrupt"))
    rows = sorted(good.collect(), key=lambda r: r["report_id"])
    assert [(r["report_id"], r["prediction_probability"], r["patient_data"]["age"]) for r in rows] == [("r-1", "0.87", 9.5), ("r-2", "0.87", 9.5)]
    assert bad.count() == 1


def test_the_last_version_of_a_report_counts(spark, tmp_path):
    from cohortlens.sources.files import FEEDBACK_SCHEMA
    from cohortlens.streaming.feedback_stream import daily_concordance, start_feedback_stream
    src, sink, ck = (tmp_path / n for n in ("src", "sink", "ck"))
    save(src, "a.json", report(1))
    save(src, "b.json", report(2))
    start_feedback_stream(spark, str(src), FEEDBACK_SCHEMA, str(sink), str(ck)).awaitTermination()
    save(src, "c.json", report(1, actual_diagnosis="non_appendicite", timestamp="2024-03-01 11:00:00"))
    save(src, "late.json", report(3, timestamp="2023-01-01 00:00:00"))
    start_feedback_stream(spark, str(src), FEEDBACK_SCHEMA, str(sink), str(ck)).awaitTermination()
    got = sorted(map(tuple, daily_concordance(spark.read.parquet(str(sink))).collect()))
    assert got == [("2023-01-01", "Vrai Positif", 1), ("2024-03-01", "Faux Positif", 1), ("2024-03-02", "Vrai Positif", 1)]


def test_column_difference_and_nan(spark):
    from cohortlens.sources.tables import column_difference, nan_to_null
    a = spark.createDataFrame([(1, float("nan"), "x")], "i int, v double, s string")
    assert column_difference(a, a.drop("v")) == ["v"] and column_difference(a, a) == []
    assert nan_to_null(a).first()["v"] is None


def test_unknown_treatments_of_model_methods_are_refused(spark):
    from cohortlens.operators.outliers import handle_outliers
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, x double")
    with pytest.raises((ValueError, TypeError)):
        handle_outliers(df, ["x"], "dbscan", "winsorise")


def test_ledger_reads_every_file_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from cohortlens.sources import files as FI
    from cohortlens.sources import ledger as LG
    monkeypatch.setattr(LG, "PATHS", 2)
    src, table, day = tmp_path / "src", str(tmp_path / "table"), F.substring("timestamp", 1, 10)
    src.mkdir()

    def put(name, text):
        (src / name).write_text(text)

    def ingest():
        return LG.ingest(spark, str(src), table, FI.FEEDBACK_SCHEMA, day)

    for i in range(5):
        put(f"r{i}.json", '{\n "report_id": "%d",\n "actual_diagnosis": "autre",\n "timestamp": "2024-01-0%d 10:00:00"\n}' % (i, i % 2 + 1))
    put("bad.json", '{\n "report_id": oops')
    assert [ingest(), ingest()] == [6, 0]
    assert LG.reports(spark, table).count() == 5 and LG.corrupt(spark, table).count() == 1
    # a changed report and a new one; a run that failed before it was noted is repeated
    put("r3.json", '{\n "report_id": "3",\n "actual_diagnosis": "appendicite",\n "timestamp": "2024-01-05 10:00:00" }')
    put("r9.json", '{ "report_id": "9", "timestamp": "2024-01-05 10:00:00" }')
    spark.createDataFrame([("half", "2024-01-09")], "report_id string, day string").write.partitionBy("day").parquet(f"{table}/rows/batch=1")
    assert [ingest(), ingest()] == [2, 0]
    rows = LG.latest(LG.reports(spark, table)).collect()
    assert {r["report_id"]: r["actual_diagnosis"] for r in rows} == {**{str(i): "autre" for i in (0, 1, 2, 4)}, "3": "appendicite", "9": None}
    assert {(r["report_id"], str(r["day"]), r["batch"]) for r in rows} >= {("3", "2024-01-05", 1), ("0", "2024-01-01", 0)}
    small = LG.compact(spark, table)
    assert LG.reports(spark, small).count() == 7 and LG.corrupt(spark, small).count() == 1
    assert LG.new_files(spark, str(src), small).count() == 0


def test_appended_records_share_files(spark, tmp_path, monkeypatch):
    """Files grow with the records' bytes: one file (and folder) a record would be as many as there are records."""
    from cohortlens.sources import files as FI
    monkeypatch.setattr(FI, "RECORDS", 40)
    rows = spark.range(100).repartition(1).selectExpr("CAST(id AS STRING) AS report_id", "'a' || chr(10) || '[{\"' AS comments", "CAST(NULL AS STRING) AS timestamp")
    FI.append_json(rows, str(tmp_path / "in" / "reports"))
    FI.append_json(rows.limit(1), str(tmp_path / "in" / "reports"))
    save(tmp_path / "in", "bad.json", '{\n    "report_id": not json')
    assert len(list((tmp_path / "in" / "reports").rglob("part-*"))) == 4
    good, bad = FI.read_feedback_json(spark, str(tmp_path / "in"), str(tmp_path / "corrupt"))
    assert sorted(int(r["report_id"]) for r in good.collect()) == sorted([0, *range(100)]) and bad.count() == 1
    assert {r["comments"] for r in good.collect()} == {'a\n[{"'}


def test_ledger_files_do_not_grow_with_days_times_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from cohortlens.sources import files as FI
    from cohortlens.sources import ledger as LG
    src, table, day = str(tmp_path / "src"), str(tmp_path / "table"), F.substring("timestamp", 1, 10)
    rows = spark.range(400).repartition(8).selectExpr("CAST(id AS STRING) AS report_id", "concat('2024-01-', lpad(CAST(1 + id % 20 AS STRING), 2, '0'), ' 10:00:00') AS timestamp")
    LG.append_records(rows, src, day)
    assert len(list((tmp_path / "src").rglob("*.json"))) == 20
    assert LG.ingest(spark, src, table, FI.FEEDBACK_SCHEMA, day, multi_line=False) == 20
    assert len(list((tmp_path / "table" / "rows").rglob("*.parquet"))) < 20
    assert LG.reports(spark, table).groupBy("day").count().where("count = 20").count() == 20
