"""Clinical feature derivation (E1-E12) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, cut, sigmoid
from ..plans.fixtures import LABS, SYMPTOM_FLAGS


def _nz(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _ge_half(c: str) -> Column:
    return F.coalesce(F.col(c) >= 0.5, F.lit(False))


def _guard_min(c: str, div: float) -> Column:
    x = F.col(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(x / div, F.lit(1.0)))


# Alvarado risk bins.
ALVARADO_BINS_A = ([float("-inf"), 4, 7, float("inf")], [0, 1, 2])
ALVARADO_BINS_B = ([0, 4, 6, 10], [0, 1, 2])


def clinical_features(df: DataFrame, symptom_cols=SYMPTOM_FLAGS, score_col: str = "alvarado_score",
                      lab_variant: str = "weighted") -> DataFrame:
    """symptom_count, absolute_neutrophils, classic_triad,
    localized_pain_with_fever, lab_composite_score, alvarado_risk."""
    cols = set(df.columns)
    out = []
    present = [c for c in symptom_cols if c in cols]
    if present:
        s = _nz(present[0])
        for c in present[1:]:
            s = s + _nz(c)
        out.append(s.alias("symptom_count"))
    if {"white_blood_cell_count", "neutrophil_percentage"} <= cols:
        out.append((F.col("white_blood_cell_count") * (F.col("neutrophil_percentage") / 100.0))
                   .alias("absolute_neutrophils"))
    if {"migration", "right_lower_quadrant_pain", "rebound_tenderness"} <= cols:
        out.append((_ge_half("migration") & _ge_half("right_lower_quadrant_pain")
                    & _ge_half("rebound_tenderness")).cast("int").alias("classic_triad"))
    if {"right_lower_quadrant_pain", "fever"} <= cols:
        out.append((_ge_half("right_lower_quadrant_pain") & _ge_half("fever")).cast("int")
                   .alias("localized_pain_with_fever"))
    if set(LABS) <= cols and lab_variant == "weighted":
        out.append(lab_composite())
    if score_col in cols:
        out.append(cut(score_col, *ALVARADO_BINS_A).alias("alvarado_risk"))
    return df.select("*", *out)


def lab_composite() -> Column:
    """.4·min(wbc/20,1) + .3·neut/100 + .3·min(crp/150,1)."""
    return (_guard_min("white_blood_cell_count", 20.0) * 0.4
            + (F.col("neutrophil_percentage") / 100.0) * 0.3
            + _guard_min("c_reactive_protein", 150.0) * 0.3).alias("lab_composite_score")


def lab_zscore_composite(stats: dict, labs=LABS) -> Column:
    """Mean of the population z-scores of the labs present in the row;
    ``stats`` = {col: (mean, sd_pop)} fitted on training rows only."""
    zs = [F.try_divide(F.col(c) - F.lit(stats[c][0]), F.lit(stats[c][1])) for c in labs]
    num = sum((F.coalesce(z, F.lit(0.0)) for z in zs[1:]), F.coalesce(zs[0], F.lit(0.0)))
    den = sum((z.isNotNull().cast("int") for z in zs[1:]), zs[0].isNotNull().cast("int"))
    return F.try_divide(num, den).alias("lab_composite_score")


def alvarado_risk_b(score_col: str = "alvarado_score") -> Column:
    """(0,4],(4,6],(6,10] -> 0,1,2; 0 and NULL -> NULL."""
    return cut(score_col, *ALVARADO_BINS_B).alias("alvarado_risk")


def wbc_neutrophil_ratio() -> Column:
    """E7."""
    return F.try_divide(F.col("white_blood_cell_count"), F.col("neutrophil_percentage")).alias("wbc_neutrophil_ratio")


def point_score(migration="migration", anorexia="anorexia", nausea_vomiting=("nausea", "vomiting"),
                rlq="right_lower_quadrant_pain", rebound="rebound_tenderness", fever="fever",
                wbc="white_blood_cell_count", neut="neutrophil_percentage") -> Column:
    """Clinical point score 0-10 (weights 1,1,1,2,1,1, 2·[wbc>10], 1·[neut>75])."""
    nv = F.greatest(*[_nz(c) for c in nausea_vomiting]) if isinstance(nausea_vomiting, tuple) else _nz(nausea_vomiting)
    s = (_nz(migration) + _nz(anorexia) + nv + _nz(rlq) * 2 + _nz(rebound) + _nz(fever)
         + F.coalesce(F.col(wbc) > 10, F.lit(False)).cast("int") * 2
         + F.coalesce(F.col(neut) > 75, F.lit(False)).cast("int"))
    return F.least(F.greatest(s, F.lit(0)), F.lit(10))


def rule_probability(score="alvarado_score") -> Column:
    """clip(score/10, .05, .95)."""
    return clip(F.col(score) / 10.0, 0.05, 0.95)


def rule_score(df: DataFrame, score="alvarado_score") -> DataFrame:
    """E9 as columns: rule_probability, rule_class (p > .5)."""
    p = rule_probability(score)
    return df.select("*", p.alias("rule_probability"), (p > 0.5).cast("int").alias("rule_class"))


# Signed rule contributions (feature, magnitude).
RULE_CONTRIBUTIONS = [
    ("right_lower_quadrant_pain", 0.3),
    ("white_blood_cell_count", 0.25),
    ("neutrophil_percentage", 0.2),
    ("fever", 0.15),
    ("duration", 0.1),
]


def rule_contributions(df: DataFrame, id_col: str) -> DataFrame:
    """Long (id, feature, contribution) of the fixed signed rule."""
    conds = {
        "right_lower_quadrant_pain": F.col("right_lower_quadrant_pain") == 1,
        "white_blood_cell_count": F.col("white_blood_cell_count") > 10,
        "neutrophil_percentage": F.col("neutrophil_percentage") > 75,
        "fever": F.col("fever") == 1,
        "duration": F.col("duration") > 24,
    }
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             F.when(F.coalesce(conds[f], F.lit(False)), F.lit(m)).otherwise(F.lit(-m)).alias("contribution"))
                    for f, m in RULE_CONTRIBUTIONS])
    return df.select(id_col, F.inline(arr))


# Weak-label rule weights.
WEAK_LABEL_WEIGHTS = [
    ("rebound_tenderness", 0.3, None),
    ("migration", 0.2, None),
    ("right_lower_quadrant_pain", 0.1, None),
    ("fever", 0.1, None),
    ("white_blood_cell_count", 0.1, 12),
    ("neutrophil_percentage", 0.1, 75),
    ("c_reactive_protein", 0.1, 50),
]


def weak_label_raw() -> Column:
    """E11 numerator: weighted rule sum (NaN comparisons false, as pandas)."""
    terms = []
    for c, w, thr in WEAK_LABEL_WEIGHTS:
        x = _nz(c) if thr is None else F.coalesce(F.col(c) > thr, F.lit(False)).cast("int")
        terms.append(x * w)
    return sum(terms[1:], terms[0])


def weak_label(df: DataFrame) -> DataFrame:
    """Rule sum / global max, > .5 -> 1.  The max is one scalar
    aggregate (partial per task), joined back as a 1-row broadcast."""
    raw = df.select("*", weak_label_raw().alias("weak_score_raw"))
    mx = raw.agg(F.max("weak_score_raw").alias("_mx"))
    j = raw.crossJoin(F.broadcast(mx))
    norm = F.try_divide(F.col("weak_score_raw"), F.col("_mx"))
    return j.select(*[F.col(c) for c in raw.columns], norm.alias("weak_score"),
                    (norm > 0.5).cast("int").alias("weak_label"))


# Logit terms (column, weight, shift, scale).
LOGIT_TERMS = [
    ("pediatric_appendicitis_score", 0.3, 0.0, 10.0),
    ("alvarado_score", 0.3, 0.0, 10.0),
    ("white_blood_cell_count", 0.2, 4.5, 15.5),
    ("neutrophil_percentage", 0.1, 40.0, 55.0),
    ("c_reactive_protein", 0.1, 0.0, 150.0),
    ("right_lower_quadrant_pain", 0.2, 0.0, 1.0),
    ("rebound_tenderness", 0.1, 0.0, 1.0),
    ("fever", 0.1, 0.0, 1.0),
    ("migration", 0.1, 0.0, 1.0),
]
LOGIT_OFFSET = -0.5


def logit_score() -> Column:
    """E12 logit (NULL inputs propagate, as NaN does)."""
    t = [((F.col(c) - F.lit(s)) / F.lit(d)) * F.lit(w) for c, w, s, d in LOGIT_TERMS]
    return sum(t[1:], t[0]) + F.lit(LOGIT_OFFSET)


def logit_probability() -> Column:
    return sigmoid(logit_score())
