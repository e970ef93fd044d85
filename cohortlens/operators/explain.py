"""Attribution.

Linear scorers get exact interventional Shapley values in closed form:
φ_j = w_j·(x_j − E[x_j]) in logit space, with E over the whole table (one
aggregate).  A row's contributions are one array column, so rankings,
running totals and records are array expressions of that row: nothing is
exploded to be grouped again.  ``long`` unrolls the array at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def background_means(df: DataFrame, features: list[str]) -> DataFrame:
    """X2 input: feature means over all rows (1 row)."""
    return df.agg(*[F.avg(c).alias(c) for c in features])


def linear_shapley(df: DataFrame, weights: dict, intercept: float, id_col: str, bg_means: DataFrame) -> DataFrame:
    """(id, base_value, prediction, contributions), contributions an array of (feature, value, contribution).
    ``weights`` {feature: w} in logit space; X3 additivity:
    base_value + Σ contribution = prediction (logit)."""
    feats = list(weights)
    m = bg_means.select(*[F.col(c).alias(f"_m_{c}") for c in feats])
    base = sum((F.col(f"_m_{c}") * weights[c] for c in feats), F.lit(float(intercept)))
    pred = sum((F.col(c) * weights[c] for c in feats), F.lit(float(intercept)))
    j = df.select(id_col, *feats).crossJoin(F.broadcast(m))        # one row of means
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                             ((F.col(c) - F.col(f"_m_{c}")) * weights[c]).alias("contribution")) for c in feats])
    return j.select(id_col, base.alias("base_value"), pred.alias("prediction"), arr.alias("contributions"))


def long(contrib: DataFrame) -> DataFrame:
    """One row per (row, feature)."""
    return contrib.select(*[c for c in contrib.columns if c != "contributions"], F.inline("contributions"))


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per feature."""
    return long(contrib).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def _ranked(n: int) -> Column:
    """The row's n contributions of largest size (ties by name), in order."""
    keyed = F.transform("contributions", lambda x: F.struct((-F.abs(x["contribution"])).alias("k"), x["feature"].alias("feature"),
                                                            x["contribution"].alias("contribution")))
    return F.slice(F.array_sort(keyed), 1, n)


def _direction(c: Column) -> Column:
    return F.when(c > 0, "Increases risk").otherwise("Decreases risk")


def top_features(contrib: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """Top-n features per row by |contribution| (ties by name) with a
    direction label."""
    t = contrib.select(id_col, F.posexplode(_ranked(n)).alias("at", "x"))
    return t.select(id_col, F.col("x.feature").alias("feature"), F.col("x.contribution").alias("contribution"),
                    (F.col("at") + 1).alias("rank"), _direction(F.col("x.contribution")).alias("direction"))


def waterfall(contrib: DataFrame, id_col: str, top: int = 10) -> DataFrame:
    """Contributions by |c| desc, top 10, running total from base value."""
    t = contrib.select(id_col, "base_value", _ranked(top).alias("r"))
    total = F.aggregate(F.slice("r", 1, F.col("at") + 1), F.lit(0.0), lambda a, x: a + x["contribution"])
    t = t.select(id_col, "base_value", "r", F.posexplode("r").alias("at", "x"))
    return t.select(id_col, "base_value", F.col("x.feature").alias("feature"), F.col("x.contribution").alias("contribution"),
                    (F.col("at") + 1).alias("rank"), (F.col("base_value") + total).alias("running_total"))


def percent_scaled(contrib: DataFrame, id_col: str) -> DataFrame:
    """|c| as % of the row's max |c|; 5 % floor when |c| > .001; cap 100."""
    t = contrib.select(id_col, F.array_max(F.transform("contributions", lambda x: F.abs(x["contribution"]))).alias("most"), "contributions")
    t = long(t)
    pct = F.try_divide(F.abs("contribution"), F.col("most")) * 100
    pct = F.when(F.abs("contribution") > 0.001, F.greatest(pct, F.lit(5.0))).otherwise(pct)
    return t.withColumn("value_percent", F.least(pct, F.lit(100.0))).drop("most")


def explanation_records(contrib: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """Per-row ordered list of (rank, feature, contribution, direction)."""
    records = F.transform(_ranked(n), lambda x, i: F.struct((i + 1).alias("rank"), x["feature"].alias("feature"),
                                                             x["contribution"].alias("contribution"), _direction(x["contribution"]).alias("direction")))
    return contrib.select(id_col, records.alias("explanation"))


def dependence(contrib: DataFrame, id_col: str, features: list[str], partner: str) -> DataFrame:
    """Value and contribution of each listed feature beside the partner feature's value, row by row."""
    beside = F.get(F.filter("contributions", lambda x: x["feature"] == partner), F.lit(0))["value"]
    t = contrib.select(id_col, beside.alias("interaction_value"), F.inline(F.filter("contributions", lambda x: x["feature"].isin(features))))
    return t.withColumn("interaction_feature", F.lit(partner))


#: Vectors that one task makes and scores: a table's splits are cut by bytes, and a row of a few bytes is hundreds of vectors here.
TASK_VECTORS = 4_000_000


def _dealt_out(df: DataFrame, vectors: int) -> DataFrame:
    """``df`` over all cores, and over as many tasks as its rows, of so many ``vectors`` each, ask for; rows are dealt in turn, whatever their ids."""
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001  (absent on Spark Connect sessions)
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2 * cores, -(-df.count() * vectors // TASK_VECTORS)))


def sampled_shapley(df: DataFrame, model_score, features: list[str], id_col: str, background: DataFrame,
                    n_perm: int = 10, seed: int = 42) -> DataFrame:
    """X1 for any model: permutation-sampling Shapley values.

    For each row and each of ``n_perm`` seeded permutations (with a
    background row chosen by hash), the F+1 prefix coalitions of the
    permutation are materialised (features in the coalition from the row,
    the rest from the background row).  All rows × permutations × (F+1)
    vectors are scored by ``model_score(df) -> df[score]`` in one Spark job;
    φ_j = mean over permutations of f(S ∪ {j}) − f(S): each scored prefix counts + for the feature just added and −
    for the next one, so one aggregate per row, combined before the shuffle, gives all features.  ``background``
    is a small sample (broadcast; its size is the caller's parameter).
    Returns long (id, feature, contribution, base_value)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    k = len(features)
    bg = background.select(*features).toPandas().to_numpy(dtype=float)
    bc = df.sparkSession.sparkContext.broadcast(bg)
    out_schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("added", T.IntegerType()),
                               T.StructField("next", T.IntegerType())]
                              + [T.StructField(f, T.DoubleType()) for f in features])

    def mix(x):
        """splitmix64 finaliser on uint64 arrays (seeded, vectorised)."""
        x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def expand(batches):
        B = bc.value
        mj = np.arange(n_perm, dtype=np.uint64)[None, :, None] * np.uint64(1000003) \
            + np.arange(k, dtype=np.uint64)[None, None, :]
        steps = np.arange(k + 1)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):                 # bounded chunk: 512 × perms × (k+1) × k
                part = pdf.iloc[lo:lo + 512]
                ids = part[id_col].to_numpy().astype(np.int64)
                X = part[features].to_numpy(dtype=float)
                n = len(ids)
                with np.errstate(over="ignore"):
                    base = mix(ids.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(seed))
                    keys = mix(base[:, None, None] + mj)                                  # n × M × k
                    zi = (mix(base[:, None] + np.arange(n_perm, dtype=np.uint64)[None, :] + np.uint64(7919))
                          % np.uint64(len(B))).astype(np.int64)                           # n × M
                perm = np.argsort(keys, axis=2, kind="stable")                           # n × M × k
                inv = np.argsort(perm, axis=2, kind="stable")                            # rank of feature j
                Z = B[zi]                                                                 # n × M × k
                inside = inv[:, :, None, :] < steps[None, None, :, None]                  # n × M × (k+1) × k
                V = np.where(inside, X[:, None, None, :], Z[:, :, None, :])
                # a feature with the background row's value leaves the vector as it is and adds 0: only vectors that differ from the one before are scored
                differs = np.take_along_axis(X[:, None, :] != Z, perm, axis=2)                 # n × M × k, in the order of the permutation
                kept = np.concatenate([np.ones((n, n_perm, 1), bool), differs], axis=2).reshape(-1)
                none = np.full((n, n_perm, 1), -1)
                added = np.concatenate([none, perm], axis=2).reshape(-1)[kept]                  # of n × M × (k+1)
                cols = {id_col: np.repeat(ids, n_perm * (k + 1))[kept], "added": added.astype(np.int32),
                        "next": np.append(added[1:], -1).astype(np.int32)}                      # a path begins with -1: the last of a path has none after it
                flat = V.reshape(-1, k)[kept]
                for j, f in enumerate(features):
                    cols[f] = flat[:, j]
                yield pd.DataFrame(cols)

    rows = df.select(F.col(id_col).cast("long").alias(id_col), *[F.col(f).cast("double") for f in features])
    coal = _dealt_out(rows, n_perm * (k + 1)).mapInPandas(expand, out_schema)
    scored = model_score(coal)
    def sign(j):
        return (F.col("added") == j).cast("double") - (F.col("next") == j).cast("double")

    sums = [(F.sum(sign(j) * F.col("score")) / n_perm).alias(f"_phi_{j}") for j in range(k)]
    base = (F.sum(F.when(F.col("added") < 0, F.col("score"))) / n_perm).alias("base_value")
    per_row = scored.groupBy(id_col).agg(base, *sums)
    return per_row.select(id_col, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_phi_{j}").alias("contribution"))
                                                     for j, f in enumerate(features)])), "base_value")
