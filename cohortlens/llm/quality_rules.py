"""Quality rules: counted base rules, and a hashed n-gram logistic regression with a fixed threshold.

Base: words are runs of other than ASCII white space.  A text fails with under ``LEAST_WORDS`` words, or where over ``REPEAT_PERCENT`` percent of its
words lie in windows of ``WINDOW`` words that the text has twice or more.

Model: words and pairs of words, and runs of three and four characters, are hashed into ``BUCKETS`` buckets each.  A bucket's value is the square
root of its share of the text's n-grams.  Weights are fitted by Spark's logistic regression on a bounded sample, the ``SAMPLE_ROWS`` labelled rows of lowest hash;
at most ``CALIBRATION_ROWS`` other rows calibrate the margin to a chance of label 1.  A text that passes the base rules is kept from a chance of ``KEEP`` on.

Scoring is one Arrow map over whole texts; a long text is hashed in pieces of ``PIECE`` characters whose n-grams overlap, so none is lost.

Defined cases: a null text has no words and fails; labels other than 0 and 1 and ids marked both ways teach nothing; with one class missing the
chance is the share of good labels, with no label 1; rows that repeat an id all count; added columns replace equal names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, shared_table, small_batches, text_slices, tidy, utf8
from .fitting import logistic, sigmoid
from .ngram_join import WordHashes

LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
BUCKETS = 1 << 13
SAMPLE_ROWS = 8000
CALIBRATION_ROWS = 4000
KEEP = 0.5
RIDGE = 1e-4
ROUNDS = 60
PIECE = 1 << 17
SLICE_BYTES = 2 << 20
#: A text's vector takes some 15 times its bytes.
VECTOR_SLICE_BYTES = 1 << 18
#: The Arrow form of Spark's vector type.
VECTOR = pa.struct([pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
                    pa.field("values", pa.list_(pa.field("element", pa.float64(), False)))])
#: Characters that count as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
_NO_CHARACTER = WHITE + bytes(range(0x80, 0xC0))  # white space and bytes that continue a character
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
ADDED = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
         "base_failed": T.BooleanType(), "p_good": T.DoubleType(), "kept": T.BooleanType()}


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FACTORS[1]
    return (h ^ (h >> np.uint64(29))) * FACTORS[3]


def _windows(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` neighbours."""
    n = len(x) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * FACTORS[0] + _spread(x[k:n + k] + np.uint64(k + 1))
    return h


def repeated_words(words: list[bytes], hashed: np.ndarray) -> int:
    """Words inside windows that stand twice or more.  Distinct hashes settle most texts; the rest are compared exactly."""
    if len(words) < WINDOW + 1:
        return 0
    h = np.sort(_windows(hashed, WINDOW))
    if (h[1:] != h[:-1]).all():
        return 0
    numbers: dict = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    reach = 1
    while reach < WINDOW:  # equal ranks of windows of ``reach`` words, doubled
        _, rank = np.unique(rank[:-reach] * (len(words) + 1) + rank[reach:], return_inverse=True)
        reach *= 2
    often = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def _characters(text: bytes):
    """The text's code points in pieces that overlap by three."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, max(1, len(points) - 2), PIECE):
        yield points[at:at + PIECE + 3].astype(np.uint64)


def features(text: bytes, hashed: np.ndarray) -> np.ndarray:
    """Values of the 2 * BUCKETS buckets: n-grams of words, then of characters."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    words, chars = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for width in (1, 2):
        if len(hashed) >= width:
            words += np.bincount((_windows(hashed, width) >> shift).astype(np.int64), minlength=BUCKETS)
    for points in _characters(text):
        for width in (3, 4):
            # the overlap of three belongs to the next piece: a piece starts PIECE n-grams of either width
            h = _windows(points, width)[:PIECE] if len(points) >= width else np.zeros(0, np.uint64)
            chars += np.bincount((h >> shift).astype(np.int64), minlength=BUCKETS)
    return np.sqrt(np.concatenate([words / max(1.0, words.sum()), chars / max(1.0, chars.sum())]))


class Reader:
    """What the rules need of a text."""

    def __init__(self):
        self.hashes = WordHashes()

    def words(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        found = text.split()
        return found, np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def base(self, text: bytes, words: list[bytes], hashed: np.ndarray) -> list:
        repeats = repeated_words(words, hashed)
        return [len(words), len(text.translate(None, _NO_CHARACTER)), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeats,
                len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)]


def _sample(docs: DataFrame, rows, text: str, row_id: str) -> DataFrame:
    ids = docs.sparkSession.createDataFrame([(r["__id"], int(r["y"])) for r in rows], "__id long, y int")  # a bounded list
    bodies = docs.select(F.col(row_id).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__body"))
    return bodies.join(F.broadcast(ids), "__id").select("__id", "y", "__body")


def vector_batches(batches):
    """Batches of texts and labels as batches of labels and sparse vectors, in the form of Spark's vector type (0: sparse).  One text's dense values
    are held at a time."""
    reader = Reader()
    for whole in batches:
        for batch in text_slices(whole, 0, VECTOR_SLICE_BYTES):
            at, values = [], []
            for text in batch.column(0).to_pylist():
                dense = features(text, reader.words(text)[1])
                at.append(np.flatnonzero(dense).astype(np.int32))
                values.append(dense[at[-1]])
            n, ends = len(at), pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            indices = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at)), type=VECTOR.field("indices").type)
            filled = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)), type=VECTOR.field("values").type)
            vectors = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 2 * BUCKETS, np.int32)), indices, filled], fields=list(VECTOR))
            yield pa.RecordBatch.from_arrays([batch.column(1), vectors], ["label", "features"])


def _sparse(rows: DataFrame) -> DataFrame:
    """Labels and vectors of the sample.  The Arrow map returns Spark's vectors as they are: no second Python step builds them row by row."""
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return rows.select("__body", F.col("y").cast("double").alias("label")).mapInArrow(tidy(vector_batches), schema)


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Weights, intercept and calibration from labelled documents."""
    small_batches(docs.sparkSession)
    marked = (labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias("__id"))
              .agg(F.min(label).alias("low"), F.max(label).alias("y")).filter("low = y").select("__id", "y", F.xxhash64("__id", F.lit(11)).alias("h")))
    # a third of the labelled rows is kept from the fit, for the calibration
    teach = marked.filter("h % 3 <> 0").orderBy("h", "__id").limit(SAMPLE_ROWS).collect()
    judge = marked.filter("h % 3 = 0").orderBy("h", "__id").limit(CALIBRATION_ROWS).collect()
    seen = [r["y"] for r in [*teach, *judge]]
    constant = {"weights": None, "constant": float(np.mean(seen)) if seen else 1.0}
    if len({r["y"] for r in teach}) < 2:
        return constant
    rows = shared_table(_sparse(_sample(docs, teach, text, row_id)), "quality-sample")
    if rows.select("label").distinct().count() < 2:
        return constant
    made = LogisticRegression(maxIter=ROUNDS, regParam=RIDGE, standardization=False).fit(rows)
    model = {"weights": made.coefficients.toArray(), "intercept": float(made.intercept), "slope": 1.0, "offset": 0.0}
    margins = _mapped(_sample(docs, judge, text, row_id), "__body", model, {"margin": T.DoubleType()}, lambda base, margin: [margin])
    known = sorted((r["margin"], r["y"]) for r in margins.select("margin", "y").collect())
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known], float)
    if len(set(y.tolist())) == 2:
        model["slope"], model["offset"] = map(float, logistic(np.column_stack([x, np.ones(len(x))]), y))
    return model


def chance(model: dict, margin: np.ndarray) -> np.ndarray:
    return np.full(len(margin), model["constant"]) if model["weights"] is None else sigmoid(model["slope"] * margin + model["offset"])


def _mapped(df: DataFrame, text: str, model: dict, added: dict, columns) -> DataFrame:
    """``df`` without its text, with ``added`` columns made from base rows and margins, in Arrow batches."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text and f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])
    arrow = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
    packed = pickle.dumps(model)
    shared, key = df.sparkSession.sparkContext.broadcast(packed), hash(packed)

    def run(batches):
        own, reader = resident(("quality_rules", key), lambda: (pickle.loads(shared.value), Reader()))
        for whole in batches:
            for batch in text_slices(whole, 0, SLICE_BYTES):
                base, margin = [], np.zeros(batch.num_rows)
                for k, body in enumerate(batch.column(0).to_pylist()):
                    body = body or b""
                    words, hashed = reader.words(body)
                    base.append(reader.base(body, words, hashed))
                    if own["weights"] is not None:
                        margin[k] = features(body, hashed) @ own["weights"] + own["intercept"]
                values = columns(base, margin)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(v, arrow[t]) for v, t in zip(values, added.values()))],
                                                 [*(f.name for f in kept), *added])

    return df.select(utf8(text).alias("__text"), *[f.name for f in kept]).mapInArrow(tidy(run), schema)


def judge(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with the base counts, ``base_failed``, the calibrated chance ``p_good`` and ``kept``."""
    def columns(base, margin):
        good = chance(model, margin)
        counts = list(zip(*base)) if base else [()] * 6
        return [*counts, good, [not failed and p >= KEEP for failed, p in zip(counts[5], good.tolist())]]

    return _mapped(docs, text, model, ADDED, columns)
