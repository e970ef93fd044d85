"""R2: feedback JSON files as they land; concordance per day, kept up to date.

Of several versions of a report the last one counts, as a saved file is overwritten.  The stream is keyed by ``BUCKETS`` hashes of the report id and holds
the last version of each of a bucket's reports as state, so that a batch is at most ``BUCKETS`` calls however many reports arrive.
A newer version takes back what the report counted for and counts anew: -1 and +1 per (day, concordance).  Each
batch folds these per day and writes them under its own number, so a batch that runs again overwrites itself.  A batch reads what arrived in it and the
state of the buckets it touches: no file is read again, and no report is too late.

``daily_concordance`` states the same over all versions at once; the tests hold the stream against it.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.feedback import concordance_label
from ..session import scratch_path

VERSION = ("event_time", "arrived", "prediction_class", "actual_diagnosis")
#: Keys of the state: with 10^9 reports a bucket's state is some 25 MB (estimated at 100 bytes a report).  A checkpoint keeps the number it began with.
BUCKETS = 4096
#: {report id: (event_us, arrived_us, prediction_class, actual_diagnosis, day, concordance)}, pickled
STATE = "reports binary"
COLUMNS = ("report_id", "event_us", "arrived_us", "prediction_class", "actual_diagnosis", "day", "concordance")
CHANGE = "day string, concordance string, change int"
BEFORE_ALL = -(1 << 62)


def daily_concordance(reports: DataFrame) -> DataFrame:
    """(day, concordance, n) over the last version of every report."""
    last = reports.groupBy("report_id").agg(F.max(F.struct(*VERSION)).alias("v")).select("report_id", "v.*")
    return (last.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day"), concordance_label().alias("concordance"))
            .agg(F.count(F.lit(1)).alias("n")))


def _versions(spark, source_dir: str, schema, multi_line: bool) -> DataFrame:
    """Every report version with its arrival time; files hold one indented report each (``multi_line``), or one a line."""
    raw = (spark.readStream.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(source_dir)
           .select("*", F.col("_metadata.file_modification_time").alias("arrived")))
    return raw.withColumn("event_time", F.try_to_timestamp("timestamp"))


def _latest(key, frames, state):
    """The changes that new versions of a bucket's reports bring about, folded per day; the state is the last version of each report."""
    last = pickle.loads(state.get[0]) if state.exists else {}
    before: dict = {}
    for frame in frames:
        for report, event, arrived, predicted, actual, day, concordance in zip(*(frame[c].tolist() for c in COLUMNS)):
            version = (event, arrived, predicted, actual, day if isinstance(day, str) else None, concordance)
            held = last.get(report)
            if held is None or version[:4] > held[:4]:
                before.setdefault(report, held)
                last[report] = version
    change: Counter = Counter()
    for report, held in before.items():
        if held is not None:
            change[held[4:]] -= 1
        change[last[report][4:]] += 1
    if before:
        state.update((pickle.dumps(last),))
    out = [(*of, n) for of, n in change.items() if n]
    yield pd.DataFrame(out, columns=["day", "concordance", "change"]).astype({"day": object, "concordance": object, "change": "int32"})


def changes(versions: DataFrame) -> DataFrame:
    """What new versions take back and add, per bucket of reports.  Rows without a report id (unreadable records) are no reports."""
    def micros(c):
        return F.coalesce(F.unix_micros(c), F.lit(BEFORE_ALL))

    rows = versions.where(F.col("report_id").isNotNull()).select(
        "report_id", micros("event_time").alias("event_us"), micros("arrived").alias("arrived_us"), F.coalesce("prediction_class", F.lit("")).alias("prediction_class"),
        F.coalesce("actual_diagnosis", F.lit("")).alias("actual_diagnosis"), F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        concordance_label().alias("concordance"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(_latest, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def start_concordance_stream(spark, source_dir: str, schema, sink_dir: str, checkpoint_dir: str, multi_line: bool = True):
    """Read what has arrived, keep the last version of each report as state, and write the batch's changes per day."""
    def fold(batch: DataFrame, number: int):
        folded = batch.groupBy("day", "concordance").agg(F.sum("change").alias("change")).where("change <> 0")
        folded.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    return (changes(_versions(spark, source_dir, schema, multi_line)).writeStream.outputMode("append").foreachBatch(fold)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def day_table(spark, sink_dir: str) -> DataFrame:
    """(day, concordance, n) from the batches' folded changes: a few rows per touched day and batch."""
    folded = spark.read.schema(CHANGE.replace("change int", "change long")).option("basePath", sink_dir).parquet(f"{sink_dir}/batch=*")
    return folded.groupBy("day", "concordance").agg(F.sum("change").alias("n")).where("n <> 0")


def compact(spark, sink_dir: str) -> str:
    """Fold all batches so far into a new folder that ``day_table`` reads, for a sink of very many batches; returns it."""
    target = scratch_path(spark, "days")
    day_table(spark, sink_dir).withColumnRenamed("n", "change").write.parquet(f"{target}/batch=0")
    return target


def start_feedback_stream(spark, source_dir: str, schema, sink_dir: str, checkpoint_dir: str, multi_line: bool = True):
    """The archive: every report version appended to a table."""
    return (_versions(spark, source_dir, schema, multi_line).writeStream.outputMode("append").format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
