"""Composite pipelines (D21, D22, D23) and the patient summary text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import patient_summary, risk_band, risk_band_sql
from ..operators import outliers as OU
from ..operators import profile as PR
from ..operators.features import rule_probability
from ..operators.missing import apply_imputer, fit_imputer
from ..operators.narrow import apply_narrowing, narrowing_plan
from ..operators.split import split_sql_expr, train_test_split
from ..session import scratch_path
from . import fixtures as FX
from .q_prep import conform
from .q_profile import _box_sql
from .registry import register
from .sqlgen import iqr_cap, median_fill, union

SC = FX.with_views("scored")
ENC = FX.with_views("encounters")


def _f18_sql():
    def s(c):
        return f"CAST({c} AS VARCHAR)"
    clinical = [f"'Pain duration: ' || {s('duration')} || ' hours'"]
    for k in ["migration", "anorexia", "nausea", "vomiting", "right_lower_quadrant_pain", "fever", "rebound_tenderness"]:
        title = " ".join(w.capitalize() for w in k.split("_"))
        clinical.append(f"CASE WHEN {k} = 1 THEN '{title}: Present' END")
    labs = [f"CASE WHEN white_blood_cell_count IS NOT NULL THEN 'WBC: ' || {s('white_blood_cell_count')} || ' ×10³/μL' END",
            f"CASE WHEN neutrophil_percentage IS NOT NULL THEN 'Neutrophils: ' || {s('neutrophil_percentage')} || '%' END",
            f"CASE WHEN c_reactive_protein IS NOT NULL THEN 'CRP: ' || {s('c_reactive_protein')} || ' mg/L' END"]
    lab_txt = "concat_ws(chr(10) || '- ', " + ", ".join(labs) + ")"
    head = f"'Age: ' || {s('age')} || ' years' || chr(10) || 'Gender: ' || {s('gender')}"
    return (ENC + f"SELECT encounter_id, concat_ws(chr(10) || chr(10), {head}, 'Clinical Features:' || chr(10) || '- ' || "
            f"concat_ws(chr(10) || '- ', {', '.join(clinical)}), CASE WHEN {lab_txt} <> '' THEN 'Laboratory Values:' || chr(10) "
            f"|| '- ' || {lab_txt} END) AS summary FROM encounters")


register("f18_patient_summary_text", _f18_sql(), family="functions")(
    lambda s, d: FX.encounters(s, d).select("encounter_id", patient_summary().alias("summary")))

D21_COLS = FX.MODEL_FEATURES


def _q_d21(s, d):
    """before/after box statistics for the ≤ 10 columns most affected by
    IQR capping (ties by name)."""
    e = FX.scored_encounters(s, d)
    capped, st = OU.handle_outliers(e, D21_COLS, "iqr", "cap")
    top = [r["column"] for r in st.where("n_outliers > 0").orderBy(F.desc("n_outliers"), "column").limit(10).collect()]
    return PR.box_stats(e, top, "original").unionByName(PR.box_stats(capped, top, "treated"))


def _d21_sql():
    cols = D21_COLS
    ranks = union([f"SELECT '{c}' AS cname, count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM scored, "
                   f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM scored) qq GROUP BY q1, q3"
                   for c in cols])
    body = _box_sql("scored", "original", cols) + " UNION ALL " + _box_sql("capped", "treated", cols)
    return (SC + f", capped AS ({iqr_cap('scored', cols)}), rk AS (SELECT cname FROM ({ranks}) r WHERE n > 0 ORDER BY n DESC, "
            f"cname LIMIT 10) SELECT * FROM ({body}) b WHERE \"column\" IN (SELECT cname FROM rk)")


register("d21_outlier_impact_top10", _d21_sql(), doubles=["q1", "median", "q3", "whisker_lo", "whisker_hi"],
         family="outliers")(_q_d21)


def _q_d22(s, d):
    """Load -> impute (median/mode) -> narrow -> IQR cap -> stratified
    split -> one partitioned Parquet table; returns the metadata rows
    (split × label counts and feature means) read back from the table."""
    e = FX.scored_encounters(s, d)
    keys = ["encounter_id", "patient_id", "seen_at", FX.TARGET]
    imp = apply_imputer(e, fit_imputer(e, "median", exclude=keys))
    nar = apply_narrowing(imp, narrowing_plan(imp, exclude=[FX.TARGET]))
    capped, _ = OU.handle_outliers(nar, FX.CONTINUOUS, "iqr", "cap")
    sp = train_test_split(capped, "encounter_id", 0.2, stratify=FX.TARGET)
    path = scratch_path(s, "d22")
    sp.write.partitionBy("split").parquet(path)
    t = s.read.parquet(path)
    return t.groupBy("split", FX.TARGET).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean_duration"),
                                             F.avg("white_blood_cell_count").alias("mean_wbc"))


register("d22_preprocess_pipeline",
         SC + f", imp AS ({median_fill('scored', FX.LABS)}), nar AS (SELECT * REPLACE ("
         + ", ".join(f"CAST(CAST({c} AS REAL) AS DOUBLE) AS {c}" for c in FX.CONTINUOUS) + f") FROM imp), cap AS ({iqr_cap('nar', FX.CONTINUOUS)}), "
         f"sp AS (SELECT *, {split_sql_expr('encounter_id', 0.2, partition='appendicitis')} AS split FROM cap) "
         "SELECT split, appendicitis, count(*) AS n, avg(duration) AS mean_duration, avg(white_blood_cell_count) AS mean_wbc "
         "FROM sp GROUP BY 1, 2", doubles=["mean_duration", "mean_wbc"], family="pipeline")(_q_d22)

EXPECTED = ["encounter_id"] + FX.MODEL_FEATURES


def _q_d23(s, d):
    """Scoring-time pipeline for a whole table: conform to the model schema,
    fill with fills fitted on training rows, flag |z| > 3 against stored
    training statistics, score (rule) and band."""
    e = FX.scored_encounters(s, d)
    sp = train_test_split(e, "encounter_id")
    train = sp.where("split = 'train'")
    fills = fit_imputer(train, "median", cols=FX.LABS)
    st = OU.fit_reference_stats(train, FX.CONTINUOUS)
    stats = {r["column"]: (r["mean"], r["sd"]) for r in st.collect()}
    rows = conform(sp, EXPECTED).drop("missing_features")
    rows = apply_imputer(rows, fills)
    rows = OU.flag_against_stats(rows, stats)
    p = rule_probability("alvarado_score")
    return rows.select("encounter_id", p.alias("probability"), risk_band(p, "app").alias("risk_band"),
                       "z_flag_count", "z_flagged")


def _d23_sql():
    sp = f"SELECT *, {split_sql_expr('encounter_id')} AS split FROM scored"
    fills = ", ".join(f"median({c}) AS f_{c}" for c in FX.LABS)
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FX.CONTINUOUS)
    filled = {c: (f"coalesce({c}, f_{c})" if c in FX.LABS else c) for c in FX.CONTINUOUS}
    z = {c: f"coalesce(abs(({filled[c]} - m_{c}) / s_{c}) > 3, false)" for c in FX.CONTINUOUS}
    cnt = " + ".join(f"CAST({z[c]} AS INTEGER)" for c in FX.CONTINUOUS)
    lst = ", ".join(f"CASE WHEN {z[c]} THEN '{c}' END" for c in FX.CONTINUOUS)
    p = "least(greatest(alvarado_score / 10.0, 0.05), 0.95)"
    return (SC + f", sp AS ({sp}), tr AS (SELECT * FROM sp WHERE split = 'train'), fl AS (SELECT {fills} FROM tr), "
            f"st AS (SELECT {st} FROM tr) SELECT encounter_id, {p} AS probability, {risk_band_sql(p, 'app')} AS risk_band, "
            f"{cnt} AS z_flag_count, concat_ws(',', {lst}) AS z_flagged FROM sp, fl, st")


register("d23_scoring_pipeline", _d23_sql(), doubles=["probability"], family="pipeline")(_q_d23)
