"""Quality classifier by compression.

Two zstandard dictionaries are trained from good and from bad labelled text.  A text is compressed
whole with either dictionary; the difference of the two compressed sizes over their sum, and nothing else, goes through a
logistic calibration to a score.

The fit uses a bounded sample, the labelled rows of lowest hash: per class at most ``DICTIONARY_ROWS`` rows for the dictionaries, whose
whole texts are cut into chunks of ``CHUNK_CHARS`` characters (beyond ``DICTIONARY_CHUNKS`` chunks a class those of lowest hash, from
anywhere in the texts), and at most ``CALIBRATION_ROWS`` other rows, compressed whole, for the calibration.  Scoring covers every
whole text.

Defined cases: null texts are scored as empty; labels other than 0 and 1 and ids marked both ways teach nothing; with one class
missing every score is the share of good labels, with no label 0.5.  Added columns replace equal names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, small_batches, text_slices, tidy, utf8
from .fitting import logistic, sigmoid

DICTIONARY_ROWS = 2000
DICTIONARY_CHUNKS = 4000
CHUNK_CHARS = 4000
DICTIONARY_BYTES = 112_640
CALIBRATION_ROWS = 20_000
LEVEL = 3
SLICE_BYTES = 2 << 20


def _dictionary(samples: list[bytes]):
    """A trained dictionary; from too few samples to train on, as many whole samples as it may hold."""
    if not any(samples):
        return b"", zstandard.DICT_TYPE_RAWCONTENT
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:
        room, taken = DICTIONARY_BYTES, []
        for sample in samples:
            if len(sample) < room:
                taken.append(sample)
                room -= len(sample) + 1
        return b"\n".join(taken), zstandard.DICT_TYPE_RAWCONTENT


class Compressors:
    def __init__(self, dictionaries):
        self.each = []
        for data, kind in dictionaries:
            own = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
            if own:
                own.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own) if own else zstandard.ZstdCompressor(level=LEVEL))

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """Of each text the normalised difference of its sizes, as a matrix of one column."""
        sizes = np.array([[len(c.compress(t or b"")) for c in self.each] for t in texts], float).reshape(-1, 2)
        good, bad = sizes.T
        return ((bad - good) / (bad + good))[:, None]


def _compressors(key, shared) -> Compressors:
    return resident(("compressors", key), lambda: Compressors(pickle.loads(shared.value)["dictionaries"]))


def _mapped(df: DataFrame, text: str, shared, key, names: list[str], fields: list, values) -> DataFrame:
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (text, *names)]
    schema = T.StructType(kept + fields)

    def run(batches):
        compressors = _compressors(key, shared)
        for whole in batches:
            for batch in text_slices(whole, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *values(compressors.features(batch.column(0).to_pylist()))],
                                                 [*(f.name for f in kept), *names])

    return df.select(utf8(text).alias("__text"), *[f.name for f in kept]).mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Dictionaries and calibration weights from labelled documents."""
    spark = docs.sparkSession
    marked = (labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("__id"))
              .agg(F.min(label).alias("low"), F.max(label).alias("y")).filter("low = y")
              .select("__id", "y", F.xxhash64("__id", F.lit(9)).alias("h")))
    chosen = marked.filter("h % 3 != 0")
    teach = [r for y in (0, 1) for r in chosen.filter(F.col("y") == y).orderBy("h", "__id").limit(DICTIONARY_ROWS).collect()]
    judge = marked.filter("h % 3 = 0").orderBy("h", "__id").limit(CALIBRATION_ROWS).collect()

    def texts(rows):  # a bounded list of ids, so it is broadcast
        ids = spark.createDataFrame([(r["__id"], int(r["y"])) for r in rows], "__id long, y int")
        return docs.join(F.broadcast(ids), docs[row_id] == ids["__id"]).select("__id", "y", F.coalesce(F.col(text), F.lit("")).alias("__body"))

    last = F.floor(F.greatest(F.length("__body") - 1, F.lit(0)) / CHUNK_CHARS).cast("int")
    chunks = (texts(teach).select("y", "__id", "__body", F.explode(F.sequence(F.lit(0), last)).alias("part"))
              .select("y", "__id", "part", F.expr(f"substring(__body, part * {CHUNK_CHARS} + 1, {CHUNK_CHARS})").alias("t"),
                      F.xxhash64("__id", "part", F.lit(9)).alias("h")))
    found = [r for y in (0, 1) for r in chunks.filter(F.col("y") == y).orderBy("h", "__id", "part", "t").limit(DICTIONARY_CHUNKS).collect()]
    found = sorted(((r["y"], r["__id"], r["part"], r["t"].encode()) for r in found))
    parts = [[t for y, _, _, t in found if y == side] for side in (1, 0)]
    model = {"dictionaries": [_dictionary(p) for p in parts]}
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    rows = _mapped(texts(judge), "__body", shared, hash(pickle.dumps(model)), ["x"], [T.StructField("x", T.ArrayType(T.DoubleType()))],
                   lambda x: [pa.array(list(x), pa.list_(pa.float64()))]).collect()
    rows.sort(key=lambda r: (r["__id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(y) == 0 or y.min() == y.max() or not all(parts):
        seen = [r["y"] for r in [*teach, *judge]]
        return model | {"constant": float(np.mean(seen)) if seen else 0.5}
    x = np.array([r["x"] for r in rows])
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    return model | {"mean": mean, "sd": sd, "weights": logistic(np.column_stack([(x - mean) / sd, np.ones(len(x))]), y)}


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """Every row with ``into``, the calibrated chance of label 1; the text column is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def calibrated(x):
        if "constant" in model:
            return [pa.array(np.full(len(x), model["constant"]), pa.float64())]
        z = np.clip((x - model["mean"]) / model["sd"], -8, 8)  # far outside the sample a feature counts as at its edge
        return [pa.array(sigmoid(z @ model["weights"][:-1] + model["weights"][-1]), pa.float64())]

    return _mapped(docs, text, shared, hash(pickle.dumps(model["dictionaries"])), [into], [T.StructField(into, T.DoubleType())], calibrated)
