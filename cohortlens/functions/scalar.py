"""Scalar column functions (F1-F18, E1-E12).  All are built-in Spark
expressions: they stay inside whole-stage codegen, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- F1-F5 -----------------------------------------------------------------

def to_number(c) -> Column:
    """string -> double, unparsable -> NULL (plain CAST raises under ANSI)."""
    name = c if isinstance(c, str) else None
    if name is not None:
        return F.expr(f"try_cast(`{name}` AS DOUBLE)")
    return c.try_cast("double")


def fill_const(c, value=0) -> Column:
    """NULL -> constant."""
    return F.coalesce(col(c), F.lit(value))


def label_to_int(c, positive: str) -> Column:
    """case-folded label == positive -> 1 else 0; NULL counts as 'Unknown'."""
    return (F.lower(F.coalesce(col(c), F.lit("Unknown"))) == F.lit(positive.lower())).cast("int")


def clip(c, lo=None, hi=None) -> Column:
    """clip to [lo, hi]; NULL stays NULL (Spark's least/greatest skip NULL)."""
    x = col(c)
    y = x
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(y)


def zscore(c, mean, sd) -> Column:
    """(c - mean) / sd; sd = 0 -> NULL."""
    m = mean if isinstance(mean, Column) else F.lit(mean)
    s = sd if isinstance(sd, Column) else F.lit(sd)
    return F.try_divide(col(c) - m, s)


# ---- F6-F8: bins and bands ---------------------------------------------------

# Right-closed bins of the reference notebooks.
PAIN_BINS = ([0, 12, 24, 48, float("inf")], ["0-12h", "12-24h", "24-48h", ">48h"])
TEMPERATURE_BINS = ([35, 37.5, 38, 38.5, float("inf")], ["Normal", "Low-grade", "Moderate", "High"])


def cut(c, edges, labels) -> Column:
    """right-closed bins (e[i], e[i+1]] -> labels[i]; outside -> NULL.
    (ML Bucketizer is left-closed, the wrong side.)"""
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = x > F.lit(lo)
        if hi != float("inf"):
            cond = cond & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def cut_sql(c: str, edges, labels) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        lab_s = f"'{lab}'" if isinstance(lab, str) else str(lab)
        cond = f"{c} > {lo}" + ("" if hi == float("inf") else f" AND {c} <= {hi}")
        parts.append(f"WHEN {cond} THEN {lab_s}")
    return "CASE " + " ".join(parts) + " END"


# The four risk-band rules (thresholds descending, labels
# from highest band to lowest).
RISK_RULES = {
    "app": ([0.7, 0.3], ["High Risk", "Moderate Risk", "Low Risk"]),
    "demo": ([0.7, 0.4], ["High", "Medium", "Low"]),
    "integration": ([0.6, 0.2], ["High", "Medium", "Low"]),
    "report": ([0.7, 0.3], ["Élevé", "Intermédiaire", "Faible"]),
}


def threshold_rule(t: float):
    """Fourth rule: >= t High, >= t/2 Medium, else Low."""
    return ([t, t / 2], ["High Risk", "Medium Risk", "Low Risk"])


def risk_band(p, rule="app") -> Column:
    """one `when` builder for every banding rule."""
    cuts, labels = RISK_RULES[rule] if isinstance(rule, str) else rule
    x = col(p)
    e = F.when(x.isNull(), F.lit(None))
    for t, lab in zip(cuts, labels):
        e = e.when(x >= F.lit(t), F.lit(lab))
    return e.otherwise(F.lit(labels[-1]))


def risk_band_sql(p: str, rule="app") -> str:
    cuts, labels = RISK_RULES[rule] if isinstance(rule, str) else rule
    s = f"CASE WHEN {p} IS NULL THEN NULL "
    s += " ".join(f"WHEN {p} >= {t} THEN '{lab}'" for t, lab in zip(cuts, labels))
    return s + f" ELSE '{labels[-1]}' END"


# Recommendation table (30 % / 70 % bands).
RECOMMENDATIONS = [
    (0.0, 0.3, "Faible", "Observation, réévaluation clinique, envisager une sortie avec consignes de retour"),
    (0.3, 0.7, "Intermédiaire", "Examens complémentaires (échographie/scanner), observation hospitalière"),
    (0.7, 1.01, "Élevé", "Consultation chirurgicale, préparation à une intervention possible"),
]


# ---- F9-F13: display -------------------------------------------------------

def pct_text(p) -> Column:
    """'12.3%' (Spark rounds half up; the raw number is kept beside it)."""
    return F.concat(F.format_string("%.1f", col(p) * 100), F.lit("%"))


# Display names of the model columns.
DISPLAY_NAMES = {
    "age": "Age (years)",
    "gender": "Gender (Male)",
    "duration": "Pain Duration (hours)",
    "migration": "Pain Migration to RLQ",
    "anorexia": "Anorexia",
    "nausea": "Nausea",
    "vomiting": "Vomiting",
    "right_lower_quadrant_pain": "Right Lower Quadrant Pain",
    "fever": "Fever",
    "rebound_tenderness": "Rebound Tenderness",
    "white_blood_cell_count": "White Blood Cell Count",
    "neutrophil_percentage": "Neutrophil Percentage",
    "c_reactive_protein": "C-Reactive Protein",
}
BOOLEAN_FEATURES = ["migration", "anorexia", "nausea", "vomiting",
                    "right_lower_quadrant_pain", "fever", "rebound_tenderness"]


def display_name(c) -> Column:
    """lookup, else snake_case -> Title Case."""
    m = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(m[col(c)], F.initcap(F.regexp_replace(col(c), "_", " ")))


def display_name_sql(c: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_NAMES.items())
    title = (f"array_to_string(list_transform(string_split({c}, '_'), "
             f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
    return f"CASE {c} {cases} ELSE {title} END"


def display_value(feature, value) -> Column:
    """NULL -> N/A; gender -> Male/Female; flags -> Yes/No; else text."""
    f, v = col(feature), col(value)
    return (F.when(v.isNull(), F.lit("N/A"))
            .when(f == "gender", F.when(v.cast("int") == 1, "Male").otherwise("Female"))
            .when(f.isin(BOOLEAN_FEATURES), F.when(v.cast("int") == 1, "Yes").otherwise("No"))
            .otherwise(v.cast("string")))


BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def human_bytes(c) -> Column:
    """1536 -> '1.50 KB'."""
    x = col(c).cast("double")
    e = None
    for i, u in enumerate(BYTE_UNITS):
        cond = x < F.lit(1024.0 ** (i + 1))
        val = F.concat(F.format_string("%.2f", F.round(x / F.lit(1024.0 ** i), 2)), F.lit(" " + u))
        e = F.when(cond, val) if e is None else e.when(cond, val)
    return e.otherwise(F.concat(F.format_string("%.2f", F.round(x / F.lit(1024.0 ** 5), 2)), F.lit(" PB")))


def report_id(ts) -> Column:
    """'APX-<epoch seconds>' from a source timestamp (never now())."""
    return F.concat(F.lit("APX-"), F.unix_timestamp(col(ts).cast("timestamp")).cast("string"))


# ---- F15 -------------------------------------------------------------------

def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


# ---- F17 -------------------------------------------------------------------

def json_int(c, path: str) -> Column:
    return F.get_json_object(col(c), path).try_cast("int")


# ---- F18 -------------------------------------------------------------------

def patient_summary(prefix: str = "") -> Column:
    """row -> structured text (present findings only, with units)."""
    p = lambda n: F.col(prefix + n)
    clinical = [F.concat(F.lit("Pain duration: "), p("duration").cast("string"), F.lit(" hours"))]
    for k in ["migration", "anorexia", "nausea", "vomiting", "right_lower_quadrant_pain", "fever", "rebound_tenderness"]:
        title = " ".join(w.capitalize() for w in k.split("_"))
        clinical.append(F.when(p(k) == 1, F.lit(f"{title}: Present")))
    labs = [
        F.when(p("white_blood_cell_count").isNotNull(),
               F.concat(F.lit("WBC: "), p("white_blood_cell_count").cast("string"), F.lit(" ×10³/μL"))),
        F.when(p("neutrophil_percentage").isNotNull(),
               F.concat(F.lit("Neutrophils: "), p("neutrophil_percentage").cast("string"), F.lit("%"))),
        F.when(p("c_reactive_protein").isNotNull(),
               F.concat(F.lit("CRP: "), p("c_reactive_protein").cast("string"), F.lit(" mg/L"))),
    ]
    head = F.concat_ws("\n", F.concat(F.lit("Age: "), p("age").cast("string"), F.lit(" years")),
                       F.concat(F.lit("Gender: "), p("gender").cast("string")))
    lab_txt = F.concat_ws("\n- ", *labs)
    return F.concat_ws("\n\n", head,
                       F.concat(F.lit("Clinical Features:\n- "), F.concat_ws("\n- ", *clinical)),
                       F.when(lab_txt != "", F.concat(F.lit("Laboratory Values:\n- "), lab_txt)))
