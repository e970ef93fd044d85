"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features of a text: its words (lower-cased runs of letters) and the first 4 to 7 letters of longer words, and one for
all words that carry a strongly associated feature; a feature that c of n words carry counts ln(1 + 200 c / (n + 10)).
One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w.x - cut_k), cut_1 < cut_2 < ...  The expected severity is the sum of these.

Labels only say clean or toxic.  Grade 0 is clean; a toxic row gets grade 1, 2 or 3 by the thirds of
the toxic rows' share of strongly associated words.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows of lowest hash.  At most ``CANDIDATES`` features (the most frequent
among toxic rows) are tested and at most ``FEATURES`` kept.  Scoring covers every whole text.

Defined cases: null and empty texts have no features and get the intercepts' severity; without both labels no row is toxic
(severity 0); rows labelled both ways teach nothing.  Added columns replace equal names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, shared_table, sheltered, small_batches, text_slices, tidy, utf8
from .fitting import lbfgs, sigmoid

SAMPLE_ROWS = 20_000
CANDIDATES = 60_000
FEATURES = 4096
LEAST_ROWS = 4
Z = 4.0
STRONG = 2.0
DENSITY = 200
GRADES = 3
ADDED = ("severity", "p_toxic", "grade")
RIDGE = 0.05
SLICE_BYTES = 2 << 20
KNOWN_WORDS = 120_000
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in range(4, min(8, len(word))))]


def words_of(text: bytes | None) -> Counter:
    return Counter(WORD.findall(text.decode("utf-8", "replace").lower())) if text else Counter()


def value(carried, words):
    """What a feature counts when ``carried`` of ``words`` words have it."""
    return np.log1p(DENSITY * np.asarray(carried, float) / (np.asarray(words, float) + 10))


class Lookup:
    """Feature numbers of words, remembered up to a bound; the number after the last counts words with a strong one."""

    def __init__(self, features: list[str], strong=()):
        self.at = {f: i for i, f in enumerate(features)}
        self.strong = set(strong)
        self.known: dict[str, tuple] = {}

    def counts(self, text: bytes | None) -> tuple[dict[int, int], int]:
        """Words that carry each feature, and all words."""
        known, out, total, pooled = self.known, {}, 0, len(self.at)
        for word, n in words_of(text).items():
            total += n
            hits = known.get(word)
            if hits is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                hits = tuple(self.at[f] for f in features_of(word) if f in self.at)
                if self.strong.intersection(hits):
                    hits += (pooled,)
                known[word] = hits
            for i in hits:
                out[i] = out.get(i, 0) + n
        return out, total


def _count_features(rows: DataFrame, only: list[str] | None) -> DataFrame:
    """(f, n): the number of rows with each feature; counted inside tasks first."""
    def run(batches):
        lookup, total = Lookup(only) if only is not None else None, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if lookup:
                    total.update(only[i] for i in lookup.counts(text)[0])
                else:
                    total.update({f for w in words_of(text) for f in features_of(w)})
        names = list(total)
        for k in range(0, len(names), 50_000):
            part = names[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[f] for f in part], pa.int64())], ["f", "n"])

    return rows.select(utf8("body")).mapInArrow(tidy(run), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _vectors(rows: DataFrame, features: list[str], strong: list[int]) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name != "body"]
    schema = T.StructType(fields + [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType())),
                                    T.StructField("words", T.IntegerType())])

    def run(batches):
        lookup = Lookup(features, strong)
        for batch in batches:
            counts = [lookup.counts(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([list(c) for c, _ in counts], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c, _ in counts], pa.list_(pa.int32())), pa.array([n for _, n in counts], pa.int32())], [*(f.name for f in fields), "at", "n", "words"])

    return rows.select(utf8("body"), *[f.name for f in fields]).mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Features, shared weights and ordered cuts from labelled documents."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = (labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("__id"))
              .agg(F.min(label).alias("low"), F.max(label).cast("int").alias("y")).filter("low = y").select("__id", "y"))
    chosen = marked.orderBy(F.xxhash64("__id", F.lit(2)), "__id").limit(SAMPLE_ROWS).collect()
    ids = spark.createDataFrame([(r["__id"], r["y"]) for r in chosen], "__id long, y int")
    sample = shared_table(docs.join(F.broadcast(ids), docs[row_id] == ids["__id"])
                          .select("__id", "y", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {"features": []}
    among_bad = {r["f"]: r["n"] for r in _count_features(sample.filter("y = 1"), None).filter(F.col("n") >= LEAST_ROWS)
                 .orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()}
    among_good = {r["f"]: r["n"] for r in _count_features(sample.filter("y = 0"), sorted(among_bad)).collect()}
    rated = []
    for f, a in among_bad.items():
        b = among_good.get(f, 0)
        odds = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        share = (a + b) / (bad + good)
        z = (a - share * bad) / math.sqrt(share * (1 - share) * bad * good / (bad + good) + 1e-9)
        if z >= Z and odds > 1:
            rated.append((-z, f, odds))
    rated = sorted(rated)[:FEATURES]
    features = [f for _, f, _ in rated]
    if not features:
        return {"features": []}
    strong = [i for i, (_, _, odds) in enumerate(rated) if odds >= STRONG]
    rows = sorted(_vectors(sample, features, strong).collect(), key=lambda r: (r["__id"], r["y"], list(r["at"])))
    return {"features": features, "strong": strong} | _ordinal(rows, len(features) + 1)


def _ordinal(rows, width: int) -> dict:
    toxic = np.array([r["y"] for r in rows])
    share = np.array([dict(zip(r["at"], r["n"])).get(width - 1, 0) / max(1, r["words"]) for r in rows])
    thirds = np.quantile(share[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + (share[:, None] > thirds).sum(axis=1), 0)
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([i for r in rows for i in r["at"]], np.int64)
    counted = value([n for r in rows for n in r["n"]], np.repeat([r["words"] for r in rows], [len(r["at"]) for r in rows]))

    def unpack(v):
        return v[:width], np.cumsum(np.concatenate([v[width:width + 1], np.exp(v[width + 1:])]))

    def loss(v):
        w, cuts = unpack(v)
        score = np.bincount(row, counted * w[at], len(rows))
        upper = np.concatenate([cuts, [np.inf]])[grade] - score  # P(y <= grade) = sigmoid(upper)
        lower = np.concatenate([[-np.inf], cuts])[grade] - score
        up, low = np.where(np.isinf(upper), 1.0, sigmoid(upper)), np.where(np.isinf(lower), 0.0, sigmoid(lower))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        gw = np.bincount(at, counted * (du - dl)[row], width) + RIDGE * w
        gc = np.array([-du[grade == k].sum() + dl[grade == k + 1].sum() for k in range(GRADES)])
        back = np.cumsum(gc[::-1])[::-1]
        back[1:] *= np.exp(v[width + 1:])
        return -np.log(p).sum() + 0.5 * RIDGE * (w @ w), np.concatenate([gw, back])

    w, cuts = unpack(lbfgs(loss, np.concatenate([np.zeros(width), [2.0], np.zeros(GRADES - 1)])))
    return {"weights": w, "cuts": cuts}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every row with expected ``severity``, ``p_toxic`` = P(grade >= 1) and the likeliest ``grade``."""
    names = list(ADDED)
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType())])
    small_batches(docs.sparkSession)
    packed = pickle.dumps(model)
    shared, key = docs.sparkSession.sparkContext.broadcast(packed), hash(packed)

    def run(batches):
        def make():
            own = pickle.loads(shared.value)
            return own, Lookup(own["features"], own.get("strong", ()))

        own, lookup = resident(("toxicity", key), make)
        for whole in batches:
            for batch in text_slices(whole, 0, SLICE_BYTES):
                sums = np.zeros(batch.num_rows)
                if own["features"]:
                    for k, text in enumerate(batch.column(0).to_pylist()):
                        counts, words = lookup.counts(text)
                        if counts:
                            at = sorted(counts)
                            sums[k] = own["weights"][at] @ value([counts[i] for i in at], words)
                    over = sigmoid(sums[:, None] - own["cuts"])
                else:
                    over = np.zeros((batch.num_rows, GRADES))
                each = np.concatenate([np.ones((batch.num_rows, 1)), over], axis=1) - np.concatenate([over, np.zeros((batch.num_rows, 1))], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(over.sum(axis=1)), pa.array(over[:, 0]),
                                                  pa.array(each.argmax(axis=1), pa.int32())], [*(f.name for f in kept), *names])

    return docs.select(utf8(text).alias("__text"), *[f.name for f in kept]).mapInArrow(tidy(run), schema)


def remove_toxic(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Documents whose P(grade >= 1) stays below ``least``, with the columns they had."""
    apart, back = sheltered(docs, ADDED)
    return score(apart, model).filter(F.col("p_toxic") < least).select(*apart.columns).withColumnsRenamed(back)
