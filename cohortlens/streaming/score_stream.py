"""Score patient rows as files arrive.

``readStream`` (Parquet, explicit schema) -> conform (P3) -> validation
(P13) -> rule probability (E9) -> risk band (F7) -> Parquet sink.  The
transformation is the same stateless function the batch path uses, so the
stream equals the batch operator on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import risk_band
from ..operators.features import point_score, rule_probability


def score_rows(df: DataFrame, stats: dict | None = None) -> DataFrame:
    """Stateless scoring shared by batch and stream: conform to the model
    schema (P3), point score, validation (P13), flags against stored
    training statistics (D17, literals — no state), probability and band."""
    from ..operators.outliers import flag_against_stats
    from ..plans.fixtures import MODEL_FEATURES
    from ..plans.q_prep import FIELD_RULES, conform, validate_rows
    s = df.withColumn("alvarado_score", point_score()).withColumn("pediatric_appendicitis_score", F.col("alvarado_score"))
    s = conform(s, ["encounter_id", "seen_at"] + MODEL_FEATURES).drop("missing_features")
    s = validate_rows(s, FIELD_RULES)
    if stats:
        s = flag_against_stats(s, stats)
    else:
        s = s.withColumn("z_flag_count", F.lit(0)).withColumn("z_flagged", F.lit(""))
    p = rule_probability("alvarado_score")
    return s.select("encounter_id", "seen_at", p.alias("probability"), (p > 0.5).cast("int").alias("prediction"),
                    risk_band(p, "app").alias("risk_band"), "violations", "z_flag_count", "z_flagged")


def start_scoring_stream(spark, source_dir: str, schema, sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                         stats: dict | None = None):
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = score_rows(stream, stats)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
