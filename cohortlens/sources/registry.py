"""Model registry (S10, S11): models saved with Spark ML writers under a
versioned folder of the shared checkpoint/warehouse path; metrics appended
as rows to a Parquet registry table; the serving model is chosen by a
query (calibrated -> standard -> any best_model*, newest first)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY_SCHEMA = ("name string, kind string, version string, path string, created_at timestamp, calibrated boolean, "
                   "auc double, accuracy double, f1 double, train_seconds double, model_mb double")


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path on the cluster file system (Hadoop FileSystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def save_model(spark: SparkSession, model, root: str, name: str, kind: str, metrics: dict, created_at,
               calibrated: bool = False) -> DataFrame:
    """Write the model and append one registry row."""
    version = created_at.strftime("%Y%m%d_%H%M%S")
    path = os.path.join(root, "models", name, version)
    model.write().overwrite().save(path)
    mb = path_bytes(spark, path) / (1024.0 * 1024.0)
    row = spark.createDataFrame([(name, kind, version, path, created_at, calibrated, metrics.get("auc"),
                                  metrics.get("accuracy"), metrics.get("f1"), metrics.get("train_seconds"), mb)],
                                REGISTRY_SCHEMA)
    row.write.mode("append").parquet(os.path.join(root, "model_registry"))
    return row


def choose_model(registry: DataFrame) -> DataFrame:
    """Fallback order calibrated -> standard -> any best_model*, newest
    first within a class; one row."""
    prio = (F.when(F.col("calibrated"), 0).when(~F.col("name").startswith("best_model"), 1).otherwise(2))
    w = Window.orderBy(prio, F.desc("created_at"), "name")          # registry: one row per saved model
    return registry.withColumn("priority", prio).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def efficiency(registry: DataFrame) -> DataFrame:
    """AUC per MB and per training second; best approach per measure."""
    t = registry.select("name", "kind", "auc", "model_mb", "train_seconds",
                        F.try_divide(F.col("auc"), F.col("model_mb")).alias("auc_per_mb"),
                        F.try_divide(F.col("auc"), F.col("train_seconds")).alias("auc_per_second"))
    w1 = Window.orderBy(F.desc("auc_per_mb"), "name")           # one row per saved model
    w2 = Window.orderBy(F.desc("auc_per_second"), "name")
    return (t.withColumn("best_per_mb", F.row_number().over(w1) == 1)
            .withColumn("best_per_second", F.row_number().over(w2) == 1))
