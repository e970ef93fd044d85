"""Source/sink round trips (S1-S9) and streaming (R1, R2).  Files go to a
fresh sub-folder of the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import risk_band_sql
from ..operators.explain import global_importance
from ..operators.split import split_sql_expr, train_test_split
from ..session import scratch_path
from ..sources import files as FI
from ..streaming.feedback_stream import day_table, start_concordance_stream
from ..streaming.score_stream import start_scoring_stream
from . import fixtures as FX
from .registry import register

ENC = FX.with_views("encounters")
SC = FX.with_views("scored")
ENC_COLS = [c for c, _ in FX.ENCOUNTER_EXPRS]
DBL = ["age", "duration"] + FX.LABS


def _q_s1(s, d):
    e = FX.encounters(s, d)
    p = scratch_path(s, "s1") + ".csv"
    e.write.option("header", True).option("timestampNTZFormat", FI.TS_FORMAT).csv(p)
    return FI.load_table(s, p, e.schema)


register("s01_csv_scan_schema", ENC + "SELECT * FROM encounters", doubles=DBL, family="sources")(_q_s1)


def _q_s3(s, d):
    e = FX.encounters(s, d)
    root = scratch_path(s, "s3")
    # one distributed write: a folder of files per site (several training files)
    e.withColumn("_group", F.concat(F.lit("encounters_"), F.col("site"))).write.partitionBy("_group") \
        .option("header", True).csv(root)
    got = FI.read_many_csv(s, root, e.schema)
    first = F.regexp_extract(F.input_file_name(), r"_group=encounters_([a-z]+)/", 1)
    return got.withColumn("file_group", first).groupBy("file_group").agg(F.count(F.lit(1)).alias("n_rows"),
                                                                           F.avg("age").alias("mean_age"))


register("s03_many_files_per_file_profile",
         ENC + "SELECT site AS file_group, count(*) AS n_rows, avg(age) AS mean_age FROM encounters GROUP BY 1",
         doubles=["mean_age"], family="sources")(_q_s3)


def _feedback_records(s, d):
    """Feedback reports as the entry form saves them: every value but the patient's is text."""
    f = FX.feedback(s, d)
    e = FX.encounters(s, d)
    pd_ = e.select(F.col("encounter_id").alias("report_id"), F.struct(
        F.col("age"), F.col("gender"), F.lit(None).cast("double").alias("prediction"),
        F.lit(None).cast("string").alias("prediction_class"), F.lit(None).cast("double").alias("probability"),
        F.lit(False).alias("contains_outliers")).alias("patient_data"))
    return f.join(pd_, "report_id", "left").select(
        F.col("report_id").cast("string").alias("report_id"), "prediction_class", F.col("prediction_probability").cast("string").alias("prediction_probability"),
        "diagnostic_accuracy", "usefulness_rating", "actual_diagnosis", "other_diagnosis", "comments",
        F.date_format(F.timestamp_seconds("ts_epoch"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "patient_data")


def _q_s4(s, d):
    root = scratch_path(s, "s4")
    rec = _feedback_records(s, d)
    FI.append_json(rec, f"{root}/reports")
    s.createDataFrame([("{\n    \"report_id\": not json",)], "value string").write.text(f"{root}/bad")
    one = rec.orderBy(F.col("report_id").cast("long")).limit(1).withColumn("report_id", F.lit("-1"))
    FI.append_json(one, f"{root}/reports")
    good, bad = FI.read_feedback_json(s, root, f"{root}-corrupt")
    return good.select("report_id", "prediction_class", "prediction_probability", "actual_diagnosis", F.col("patient_data.age").alias("age")).unionByName(
        bad.select(F.lit("corrupt").alias("report_id")), allowMissingColumns=True)


register("s04_s08_json_feedback_scan",
         FX.with_views("feedback", "encounters") + ", f AS (SELECT CAST(report_id AS VARCHAR) AS report_id, report_id AS n, prediction_class, "
         "CAST(prediction_probability AS VARCHAR) AS prediction_probability, actual_diagnosis FROM feedback) "
         "SELECT f.report_id, f.prediction_class, prediction_probability, f.actual_diagnosis, e.age FROM f "
         "LEFT JOIN encounters e ON e.encounter_id = f.n UNION ALL SELECT '-1', prediction_class, prediction_probability, actual_diagnosis, e.age "
         "FROM (SELECT * FROM f ORDER BY n LIMIT 1) f LEFT JOIN encounters e ON e.encounter_id = f.n "
         "UNION ALL SELECT 'corrupt', NULL, NULL, NULL, NULL",
         doubles=["age"], family="sources")(_q_s4)


def _q_s4_ledger(s, d):
    """Two waves of report files and an unreadable record; every wave is ingested twice, the second time adds nothing."""
    from ..sources import ledger as LG
    src, table = scratch_path(s, "reports"), scratch_path(s, "ingested")
    rec = _feedback_records(s, d)
    day = F.substring("timestamp", 1, 10)
    for wave in (0, 1):
        LG.append_records(rec.where(F.col("report_id").cast("long") % 2 == wave), f"{src}/wave{wave}", day)
        if wave:
            s.createDataFrame([("{ \"report_id\": not json",)], "value string").write.text(f"{src}/bad")
        first = LG.ingest(s, src, table, FI.FEEDBACK_SCHEMA, day, multi_line=False)
        again = LG.ingest(s, src, table, FI.FEEDBACK_SCHEMA, day, multi_line=False)
        if not first or again:
            raise RuntimeError(f"wave {wave}: {first} files read, then {again}")
    good = LG.latest(LG.reports(s, table)).select("report_id", "prediction_class", "actual_diagnosis", F.col("day").cast("string").alias("day"), "batch")
    return good.unionByName(LG.corrupt(s, table).select(F.lit("corrupt").alias("report_id"), "batch"), allowMissingColumns=True)


register("s04_s08_ledger_ingest",
         FX.with_views("feedback") + "SELECT CAST(report_id AS VARCHAR) AS report_id, prediction_class, actual_diagnosis, "
         "strftime(to_timestamp(ts_epoch)::TIMESTAMP, '%Y-%m-%d') AS day, CAST(report_id % 2 AS INTEGER) AS batch FROM feedback "
         "UNION ALL SELECT 'corrupt', NULL, NULL, NULL, 1", family="sources")(_q_s4_ledger)


def _q_s5(s, d):
    p = scratch_path(s, "s5")
    sp = train_test_split(FX.encounters(s, d), "encounter_id")
    FI.write_split_table(sp.select("encounter_id", "age", "appendicitis", "split"), p)
    # partition pruning: only split=test files are listed and read
    return s.read.parquet(p).where(F.col("split") == "test").select("encounter_id", "age", "appendicitis")


register("s05_s06_split_table_roundtrip",
         ENC + f"SELECT encounter_id, age, appendicitis FROM (SELECT *, {split_sql_expr('encounter_id')} AS split FROM encounters) "
         "WHERE split = 'test'", doubles=["age"], family="sources")(_q_s5)


def _q_s7(s, d):
    from ..operators.encode import fit_standard
    p = scratch_path(s, "s7")
    sp = train_test_split(FX.encounters(s, d), "encounter_id")
    params = fit_standard(sp.where("split = 'train'"), DBL)
    t = s.createDataFrame([(c, m, sd) for c, (m, sd) in params.items()], "column string, mean double, sd double")
    t.coalesce(1).write.parquet(p + "/scaler")
    return s.read.parquet(p + "/scaler")


register("s07_scaler_params_table",
         ENC + f", tr AS (SELECT * FROM (SELECT *, {split_sql_expr('encounter_id')} AS split FROM encounters) WHERE split = 'train') "
         + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS sd FROM tr" for c in DBL),
         doubles=["mean", "sd"], family="sources")(_q_s7)


def _q_s9(s, d):
    from .q_misc import contributions
    p = scratch_path(s, "s9")
    global_importance(contributions(s, d)).coalesce(1).write.option("header", True).csv(p)
    return s.read.schema("feature string, mean_abs_contribution double").option("header", True).csv(p)


def _s9_sql():
    from .q_misc import CONTRIB
    return CONTRIB + "SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM contrib GROUP BY 1"


register("s09_importance_csv", _s9_sql(), doubles=["mean_abs_contribution"], family="sources")(_q_s9)


def _q_r1(s, d):
    src, sink, ck = scratch_path(s, "r1-src"), scratch_path(s, "r1-sink"), scratch_path(s, "r1-ckpt")
    e = FX.encounters(s, d)
    # stored statistics: fitted once in batch on the training split
    from ..operators.outliers import fit_reference_stats
    sc = FX.scored_encounters(s, d)
    tr = train_test_split(sc, "encounter_id").where("split = 'train'")
    stats = {r["column"]: (r["mean"], r["sd"]) for r in fit_reference_stats(tr, STREAM_Z).collect()}
    # arriving files, whatever tasks hold: a day may be many files
    e.write.parquet(src)
    q = start_scoring_stream(s, src, e.schema, sink, ck, stats=stats)
    q.awaitTermination()
    return s.read.parquet(sink)


STREAM_Z = FX.CONTINUOUS + ["alvarado_score"]


def _r1_sql():
    from .q_prep import VIOLATIONS_SQL
    p = "least(greatest(alvarado_score / 10.0, 0.05), 0.95)"
    tr = f"SELECT * FROM (SELECT *, {split_sql_expr('encounter_id')} AS split FROM scored) WHERE split = 'train'"
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STREAM_Z)
    z = {c: f"coalesce(abs(({c} - m_{c}) / s_{c}) > 3, false)" for c in STREAM_Z}
    cnt = " + ".join(f"CAST({z[c]} AS INTEGER)" for c in STREAM_Z)
    lst = ", ".join(f"CASE WHEN {z[c]} THEN '{c}' END" for c in STREAM_Z)
    return (SC + f", st AS (SELECT {st} FROM ({tr}) t) SELECT encounter_id, seen_at, {p} AS probability, "
            f"CAST({p} > 0.5 AS INTEGER) AS prediction, {risk_band_sql(p, 'app')} AS risk_band, "
            f"{VIOLATIONS_SQL} AS violations, {cnt} AS z_flag_count, concat_ws(',', {lst}) AS z_flagged "
            "FROM scored, st")


register("r1_scoring_stream_equals_batch", _r1_sql(), doubles=["probability"], family="streaming")(_q_r1)


def logistic_expr(model, fills):
    """The serving pipeline's score written out from its numbers: fill, scale, coefficients, Platt's line."""
    learner, calibration = model.stages[2], model.stages[3] if len(model.stages) > 3 else None
    z = F.lit(float(learner.intercept))
    for k, c in enumerate(FX.MODEL_FEATURES):
        m, sd = fills[c][1], fills[c][2]
        z = z + (F.coalesce(F.col(c).cast("double"), F.lit(fills[c][0])) - m) / sd * float(learner.coefficients[k])
    p = 1.0 / (1.0 + F.exp(-z))
    if calibration is None:
        return p
    return 1.0 / (1.0 + F.exp(-(p * calibration.getOrDefault("slope") + calibration.getOrDefault("offset"))))


def _q_r1_model(s, d):
    """Two waves of encounters; a calibrated model is saved between them, so the first wave has the standard one's scores and the second the
    calibrated one's.  ``n_off`` counts rows that differ from the score written out from the model's numbers."""
    import datetime as dt

    from ..operators.calibrated import medians, serving_pipeline
    from ..operators.encode import fit_standard
    from ..session import written
    from ..sources.registry import save_model
    from ..streaming.model_stream import scored_rows, start_model_stream
    root, src, sink, ck = (scratch_path(s, f"r1m-{n}") for n in ("models", "src", "sink", "ckpt"))
    feats = FX.MODEL_FEATURES
    rows = written(FX.scored_encounters(s, d).select("encounter_id", *feats, F.col("appendicitis").alias("label")), "arrivals")
    split = train_test_split(rows, "encounter_id", 0.2)
    tr, hold = written(split.where("split = 'train'"), "fit-rows"), split.where("split = 'test'")
    fills = medians(tr, feats)
    params = fit_standard(tr.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in feats]), feats)
    numbers = {c: (fills[c], float(params[c][0]), float(params[c][1] or 1.0)) for c in feats}
    made = {}
    for wave, (name, calibrate) in enumerate([("standard_lr", None), ("calibrated_lr", hold)]):
        made[name] = serving_pipeline(tr, feats, "logistic", "label", fills, calibrate, n_rows=1000)
        save_model(s, made[name], root, name, "logistic", {}, dt.datetime(2024, 1, 1) + dt.timedelta(days=wave), calibrated=calibrate is not None)
        rows.where(F.col("encounter_id") % 2 == wave).write.mode("append").parquet(src)
        start_model_stream(s, src, rows.schema, root, sink, ck, keep=["encounter_id", *feats]).awaitTermination()
    out = scored_rows(s, sink)
    want = F.coalesce(*[F.when(F.col("model") == n, logistic_expr(m, numbers)) for n, m in made.items()])
    return (out.groupBy(F.col("batch").cast("int").alias("batch"), "model", "version")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("encounter_id") % 2 != F.col("batch")).alias("n_other_wave"),
                 F.count_if(F.abs(F.col("score") - want) > 1e-9).alias("n_off"), F.count_if(F.col("score").isNull()).alias("n_unscored")))


register("r1_model_stream_registry_version",
         ENC + "SELECT CAST(encounter_id % 2 AS INTEGER) AS batch, CASE encounter_id % 2 WHEN 0 THEN 'standard_lr' ELSE 'calibrated_lr' END AS model, "
         "CASE encounter_id % 2 WHEN 0 THEN '20240101_000000' ELSE '20240102_000000' END AS version, count(*) AS n_rows, 0 AS n_other_wave, 0 AS n_off, "
         "0 AS n_unscored FROM encounters GROUP BY 1, 2, 3", family="streaming")(_q_r1_model)


def _q_r2(s, d):
    """Reports arrive in two rounds; every seventh comes again with another diagnosis, some a month late."""
    src, sink, ck = scratch_path(s, "r2-src"), scratch_path(s, "r2-sink"), scratch_path(s, "r2-ckpt")
    rec = _feedback_records(s, d)
    again = rec.where(F.col("report_id").cast("long") % 7 == 0)
    late = F.to_timestamp("timestamp") + F.expr("INTERVAL 90 MINUTES")
    again = again.withColumn("actual_diagnosis", F.lit("appendicite")).withColumn("timestamp", F.date_format(late, "yyyy-MM-dd HH:mm:ss"))
    for part in (rec, again):
        part.write.mode("append").json(src)
        start_concordance_stream(s, src, FI.FEEDBACK_SCHEMA, sink, ck, multi_line=False).awaitTermination()
    return day_table(s, sink)


def _r2_sql():
    from ..operators.feedback import CONCORDANCE, UNDETERMINED
    conc = " ".join(f"WHEN prediction_class = '{p}' AND actual_diagnosis = '{a}' THEN '{lab}'" for p, a, lab in CONCORDANCE)
    return (FX.with_views("feedback") + ", ev AS (SELECT report_id, prediction_class, CASE WHEN report_id % 7 = 0 THEN 'appendicite' ELSE actual_diagnosis END "
            "AS actual_diagnosis, to_timestamp(ts_epoch + CASE WHEN report_id % 7 = 0 THEN 5400 ELSE 0 END)::TIMESTAMP AS t FROM feedback) "
            f"SELECT strftime(date_trunc('day', t), '%Y-%m-%d') AS day, CASE {conc} ELSE '{UNDETERMINED}' END AS concordance, "
            "count(*) AS n FROM ev GROUP BY 1, 2")


register("r2_feedback_stream_daily_concordance", _r2_sql(), family="streaming")(_q_r2)
