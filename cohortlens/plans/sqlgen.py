"""Small generators of DuckDB oracle text (repetitive per-column SQL)."""

from __future__ import annotations


def median_fill(src: str, cols: list[str]) -> str:
    """SELECT src with NULLs of ``cols`` replaced by the column median."""
    meds = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    rep = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in cols)
    return f"SELECT s.* REPLACE ({rep}) FROM {src} s, (SELECT {meds} FROM {src}) mm"


def iqr_cap(src: str, cols: list[str], k: float = 1.5) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    rep = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, q1_{c} - {k} * (q3_{c} - q1_{c})), "
        f"q3_{c} + {k} * (q3_{c} - q1_{c})) END AS {c}" for c in cols)
    return f"SELECT s.* REPLACE ({rep}) FROM {src} s, (SELECT {qs} FROM {src}) qq"


LAB_COMPOSITE_SQL = (
    "(CASE WHEN white_blood_cell_count IS NULL THEN NULL ELSE least(white_blood_cell_count / 20.0, 1.0) END)"
    " * CAST(0.4 AS DOUBLE) + (neutrophil_percentage / 100.0) * CAST(0.3 AS DOUBLE)"
    " + (CASE WHEN c_reactive_protein IS NULL THEN NULL ELSE least(c_reactive_protein / 150.0, 1.0) END)"
    " * CAST(0.3 AS DOUBLE)"
)

SYMPTOM_COUNT_SQL = ("coalesce(migration,0) + coalesce(anorexia,0) + coalesce(nausea,0) + coalesce(vomiting,0)"
                     " + coalesce(right_lower_quadrant_pain,0) + coalesce(fever,0) + coalesce(rebound_tenderness,0)")

CLINICAL_FEATURES_SQL = (
    f"{SYMPTOM_COUNT_SQL} AS symptom_count, "
    "white_blood_cell_count * (neutrophil_percentage / 100.0) AS absolute_neutrophils, "
    "CAST(coalesce(migration >= 0.5 AND right_lower_quadrant_pain >= 0.5 AND rebound_tenderness >= 0.5, false) AS INT)"
    " AS classic_triad, "
    "CAST(coalesce(right_lower_quadrant_pain >= 0.5 AND fever >= 0.5, false) AS INT) AS localized_pain_with_fever, "
    f"{LAB_COMPOSITE_SQL} AS lab_composite_score, "
    "CASE WHEN alvarado_score <= 4 THEN 0 WHEN alvarado_score <= 7 THEN 1 WHEN alvarado_score > 7 THEN 2 END"
    " AS alvarado_risk"
)

RULE_PROB_SQL = "least(greatest(alvarado_score / 10.0, 0.05), 0.95)"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def per_col(cols: list[str], template: str) -> str:
    """UNION ALL of ``template.format(c=col)`` over columns."""
    return union([template.format(c=c) for c in cols])
