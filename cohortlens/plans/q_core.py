"""Flagship slice and preparation-pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import risk_band, risk_band_sql
from ..operators import features as FE
from ..operators.missing import impute
from ..operators.outliers import handle_outliers
from ..operators.profile import crosstab
from . import fixtures as FX
from .registry import register
from .sqlgen import CLINICAL_FEATURES_SQL, RULE_PROB_SQL, iqr_cap, median_fill


def prepared_features(spark, sf_dir):
    """encounters -> D1 median impute -> D3+D6 IQR cap -> E1-E6a -> E9 -> F7."""
    enc = FX.scored_encounters(spark, sf_dir)
    imp = impute(enc, "median", exclude=["encounter_id", "patient_id", "seen_at", FX.TARGET])
    capped, _ = handle_outliers(imp, FX.CONTINUOUS, "iqr", "cap")
    feat = FE.rule_score(FE.clinical_features(capped))
    return feat.withColumn("risk_band", risk_band("rule_probability", "app"))


PREPARED_SQL = (
    FX.with_views("scored")
    + f", imp AS ({median_fill('scored', FX.LABS)}), cap AS ({iqr_cap('imp', FX.CONTINUOUS)}), "
    f"feat AS (SELECT *, {CLINICAL_FEATURES_SQL}, {RULE_PROB_SQL} AS rule_probability FROM cap), "
    f"banded AS (SELECT *, {risk_band_sql('rule_probability', 'app')} AS risk_band FROM feat) "
)


def flagship(spark, sf_dir):
    """A14 band × label table plus feature means per band: one grouped
    aggregation (partial per task) over the prepared rows."""
    feat = prepared_features(spark, sf_dir)
    y = F.col(FX.TARGET)
    return feat.groupBy("risk_band").agg(
        F.count_if(y == 0).alias("n_0"), F.count_if(y == 1).alias("n_1"), F.count(F.lit(1)).alias("n"),
        (F.count_if(y == 1) * 100.0 / F.count(F.lit(1))).alias("pct_1"),
        F.avg("lab_composite_score").alias("avg_lab_composite"),
        F.avg("absolute_neutrophils").alias("avg_abs_neutrophils"),
        F.avg("symptom_count").alias("avg_symptom_count"),
        F.sum("classic_triad").cast("bigint").alias("n_classic_triad"))


register("flagship_band_by_label",
         PREPARED_SQL + "SELECT risk_band, count_if(appendicitis = 0) AS n_0, count_if(appendicitis = 1) AS n_1, "
         "count(*) AS n, count_if(appendicitis = 1) * 100.0 / count(*) AS pct_1, "
         "avg(lab_composite_score) AS avg_lab_composite, avg(absolute_neutrophils) AS avg_abs_neutrophils, "
         "avg(symptom_count) AS avg_symptom_count, CAST(sum(classic_triad) AS BIGINT) AS n_classic_triad "
         "FROM banded GROUP BY risk_band",
         doubles=["pct_1", "avg_lab_composite", "avg_abs_neutrophils", "avg_symptom_count"], family="pipeline")(flagship)
