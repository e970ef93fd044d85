"""R1 with a trained model: rows are scored as files arrive, by the registry's model of the moment.

Between batches the registry is asked which model serves (calibrated, then standard, newest first).  A batch notes its model before it scores; if it
runs again after a failure it reads the note, so its rows never mix two versions, and it overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calibrated import serve
from ..sources.registry import REGISTRY_SCHEMA, choose_model, path_exists

NOTE = "batch long, name string, version string, path string"


def model_of_batch(spark: SparkSession, root: str, sink_dir: str, number: int):
    """The noted model of a batch; where there is none, the registry's choice, which is noted first."""
    note = f"{sink_dir}/models/batch_{number}"
    if not path_exists(spark, f"{note}/_SUCCESS"):
        chosen = choose_model(spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/model_registry")).first()
        spark.createDataFrame([(number, chosen["name"], chosen["version"], chosen["path"])], NOTE).write.mode("overwrite").parquet(note)
    return spark.read.schema(NOTE).parquet(note).first()


def start_model_stream(spark: SparkSession, source_dir: str, schema, root: str, sink_dir: str, checkpoint_dir: str,
                       prepare: Callable[[DataFrame], DataFrame] = lambda df: df, keep: list[str] | None = None):
    """Score what has arrived under ``source_dir`` (Parquet) with the registry under ``root``; a folder per batch under ``sink_dir``/rows."""
    def each(batch: DataFrame, number: int):
        own = batch.sparkSession
        note = model_of_batch(own, root, sink_dir, number)
        rows = serve(PipelineModel.load(note["path"]), prepare(batch))
        kept = rows.select(*(keep or [c for c in rows.columns if c not in ("score", "pred")]), "score", "pred",
                           F.lit(note["name"]).alias("model"), F.lit(note["version"]).alias("version"))
        kept.write.mode("overwrite").parquet(f"{sink_dir}/rows/batch={number}")

    return (spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def scored_rows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Everything scored so far, with the batch's number."""
    return spark.read.option("basePath", f"{sink_dir}/rows").parquet(f"{sink_dir}/rows/batch=*")
