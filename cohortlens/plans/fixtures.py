"""Fixture views over the driver tables.

Each view is one list of ``(name, SQL expression)`` pairs.  The same text is
used by Spark (``selectExpr``) and by the DuckDB oracle, so a query and its
oracle start from the identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

# The 15 model columns and the target of the clinical table.
MODEL_FEATURES = [
    "age", "gender", "duration", "migration", "anorexia", "nausea", "vomiting",
    "right_lower_quadrant_pain", "fever", "rebound_tenderness",
    "white_blood_cell_count", "neutrophil_percentage", "c_reactive_protein",
    "pediatric_appendicitis_score", "alvarado_score",
]
TARGET = "appendicitis"
SYMPTOM_FLAGS = ["migration", "anorexia", "nausea", "vomiting",
                 "right_lower_quadrant_pain", "fever", "rebound_tenderness"]
LABS = ["white_blood_cell_count", "neutrophil_percentage", "c_reactive_protein"]
CONTINUOUS = ["age", "duration"] + LABS

# The encounters view (FIXTURES.md §2), one expression per column.
ENCOUNTER_EXPRS = [
    ("encounter_id", "event_id"),
    ("patient_id", "user_id"),
    ("seen_at", "ts"),
    ("site", "event_type"),
    ("age", "CAST(1 + (event_id * 7919 % 171) / 10.0 AS DOUBLE)"),
    ("gender", "CAST(event_id * 31 % 2 AS INT)"),
    ("duration", "CAST((event_id * 104729 % 1200) / 10.0 AS DOUBLE)"),
    ("migration", "CAST(CASE WHEN value + (event_id * 13 % 40) > 60 THEN 1 ELSE 0 END AS INT)"),
    ("anorexia", "CAST(CASE WHEN value + (event_id * 17 % 60) > 55 THEN 1 ELSE 0 END AS INT)"),
    ("nausea", "CAST(CASE WHEN value + (event_id * 19 % 80) > 50 THEN 1 ELSE 0 END AS INT)"),
    ("vomiting", "CAST(CASE WHEN value + (event_id * 23 % 60) > 70 THEN 1 ELSE 0 END AS INT)"),
    ("right_lower_quadrant_pain", "CAST(CASE WHEN value + (event_id * 29 % 60) > 45 THEN 1 ELSE 0 END AS INT)"),
    ("fever", "CAST(CASE WHEN value + (event_id * 37 % 60) > 75 THEN 1 ELSE 0 END AS INT)"),
    ("rebound_tenderness", "CAST(CASE WHEN value + (event_id * 41 % 60) > 65 THEN 1 ELSE 0 END AS INT)"),
    ("white_blood_cell_count", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 4.0 + value / 20.0 + (event_id * 43 % 80) / 10.0 END"),
    ("neutrophil_percentage", "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 40.0 + least(value / 4.0, 30.0) + (event_id * 47 % 250) / 10.0 END"),
    ("c_reactive_protein", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value + (event_id * 53 % 50) END"),
    ("us_finding", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'seen' END"),
    ("appendicitis", "CAST(CASE WHEN value + (event_id * 59 % 70) > 85 THEN 1 ELSE 0 END AS INT)"),
]

# Clinical point score (operator E8), used for both score columns of the
# model schema.  nausea_vomiting of the scoring rule = either flag present.
POINT_SCORE_SQL = (
    "least(greatest(migration + anorexia + greatest(nausea, vomiting) + 2 * right_lower_quadrant_pain"
    " + rebound_tenderness + fever"
    " + 2 * (CASE WHEN white_blood_cell_count > 10 THEN 1 ELSE 0 END)"
    " + (CASE WHEN neutrophil_percentage > 75 THEN 1 ELSE 0 END), 0), 10)"
)

# A feedback table derived from `conversations`: one report per turn.
# Ratings arrive as text (some unparsable, some missing) as in the
# reference's JSON records.
FEEDBACK_EXPRS = [
    ("report_id", "CAST(conv_id * 10 + turn AS BIGINT)"),
    ("conv_id", "conv_id"),
    ("prediction_class", "CASE (conv_id + turn) % 3 WHEN 0 THEN 'Élevé' WHEN 1 THEN 'Faible' ELSE 'Intermédiaire' END"),
    ("prediction_probability", "CAST(5 + (conv_id * 37 + turn * 11) % 91 AS DOUBLE) / 100.0"),
    ("diagnostic_accuracy", "CASE WHEN (conv_id + turn) % 17 = 0 THEN 'n/a' ELSE CAST(1 + (length(text) + turn) % 5 AS STRING) END"),
    ("usefulness_rating", "CASE WHEN (conv_id * 3 + turn) % 19 = 0 THEN NULL ELSE CAST(1 + (length(text) * 7 + conv_id) % 5 AS STRING) END"),
    ("actual_diagnosis", "CASE (conv_id * 7 + turn) % 4 WHEN 0 THEN 'appendicite' WHEN 1 THEN 'non_appendicite' WHEN 2 THEN 'autre' ELSE 'appendicite' END"),
    ("other_diagnosis", "CASE WHEN (conv_id * 5 + turn) % 3 = 0 THEN 'gastro' || CAST(conv_id % 7 AS STRING) ELSE NULL END"),
    ("comments", "CASE WHEN role = 'system' THEN '   ' ELSE text END"),
    ("ts_epoch", "CAST(1704067200 + conv_id * 3600 + turn * 600 AS BIGINT)"),
]

# Document-quality scores: labels joined to documents (FIXTURES.md §3).
DOC_SCORE_SQL = (
    "SELECT l.doc_id AS doc_id, l.quality AS quality, l.toxic AS toxic, d.n_chars AS n_chars, d.lang AS lang,"
    " CAST(1.0 / (1.0 + exp(-(ln(d.n_chars + 1.0) - 7.0))) AS DOUBLE) AS score"
    " FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
)


def _select_sql(exprs, table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs) + f" FROM {table}"


def encounters_sql() -> str:
    return _select_sql(ENCOUNTER_EXPRS, "events")


def scored_encounters_sql() -> str:
    return (f"SELECT *, {POINT_SCORE_SQL} AS pediatric_appendicitis_score, "
            f"{POINT_SCORE_SQL} AS alvarado_score FROM ({encounters_sql()}) e0")


def feedback_sql() -> str:
    return _select_sql(FEEDBACK_EXPRS, "conversations")


VIEW_SQL = {
    "encounters": encounters_sql,
    "scored": scored_encounters_sql,
    "feedback": feedback_sql,
    "doc_scores": lambda: DOC_SCORE_SQL,
}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views for oracle SQL."""
    return "WITH " + ", ".join(f"{n} AS ({VIEW_SQL[n]()})" for n in names) + " "


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr(*[f"{e} AS {n}" for n, e in ENCOUNTER_EXPRS])


def scored_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encounters + both point-score columns = the 15-column model schema."""
    return encounters(spark, sf_dir).selectExpr(
        "*", f"{POINT_SCORE_SQL} AS pediatric_appendicitis_score", f"{POINT_SCORE_SQL} AS alvarado_score")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return conv.selectExpr(*[f"{e} AS {n}" for n, e in FEEDBACK_EXPRS])


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    # labels cover a subset of documents; Catalyst picks the join strategy
    # (broadcast only when the labels side is under the size threshold).
    j = lab.join(doc, "doc_id")
    return j.select(
        "doc_id", "quality", "toxic", "n_chars", "lang",
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(F.col("n_chars") + F.lit(1.0)) - F.lit(7.0))))).alias("score"))
