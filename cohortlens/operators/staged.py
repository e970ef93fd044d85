"""Grid search where one fit serves many candidates (M6).

Boosting: a run of 300 rounds holds the runs of 100 and 200 as its first trees, so the rounds axis costs one fit.
Forest: the first 100 of 300 trees, and trees read no deeper than 10 of 30 levels, are a forest of that size and depth: a draw of its own, not the one
that a separate fit with the same seed would give (Spark draws a node's features in the order in which nodes are split).

The trees of a fitted model are read from Spark's own saved form into node arrays.  One Arrow pass over the held-out rows walks them and gives every candidate's
score; one grouped job gives every candidate's AUC.  The node arrays are as large as the model that Spark broadcasts for its own scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .metrics import auc as auc_of

#: Parameters along which one fit holds the smaller ones.
NESTED = {"gbt": ("maxIter",), "random_forest": ("numTrees", "maxDepth")}
ROWS = 4096


class Trees:
    """All nodes of an ensemble: split feature (-1 at a leaf), threshold, children, value; first node and weight of each tree."""

    def __init__(self, spark, model, boosted: bool):
        path = scratch_path(spark, "trees")
        model.write().save(path)
        node = F.col("nodeData")
        stats = node["impurityStats"]
        value = node["prediction"] if boosted else F.try_divide(F.get(stats, F.lit(1)), F.get(stats, F.lit(0)) + F.get(stats, F.lit(1)))
        rows = spark.read.parquet(f"{path}/data").select(
            "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), F.coalesce(value, F.lit(0.0)).alias("value")).toPandas().sort_values(["treeID", "id"])
        tree = rows["treeID"].to_numpy()
        self.first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        base = np.repeat(self.first, np.diff(np.append(self.first, len(tree))))  # node numbers count from 0 in each tree
        self.feature = rows["feature"].to_numpy(np.int32)
        self.threshold = rows["threshold"].fillna(0.0).to_numpy(float)
        self.left, self.right = (rows[c].to_numpy(np.int64) + base for c in ("left", "right"))
        self.value = rows["value"].to_numpy(float)
        self.weight = np.array(model.treeWeights, float)

    def walk(self, x: np.ndarray, tree: int, depths: list[int]) -> list[np.ndarray]:
        """Each row's value in one tree read down to each of the (rising) depths."""
        at, out, row = np.full(len(x), self.first[tree]), [], np.arange(len(x))
        for level in range(depths[-1] + 1):
            while len(out) < len(depths) and depths[len(out)] == level:
                out.append(self.value[at])
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            k, r = at[inner], row[inner]
            at[inner] = np.where(x[r, self.feature[k]] <= self.threshold[k], self.left[k], self.right[k])
        return out + [self.value[at]] * (len(depths) - len(out))

    def boosted(self, x: np.ndarray, rounds: list[int]) -> np.ndarray:
        """Chance of label 1 after each (rising) number of rounds."""
        margin, out = np.zeros(len(x)), []
        for t in range(len(self.first)):
            margin = margin + self.weight[t] * self.walk(x, t, [1 << 20])[0]
            while len(out) < len(rounds) and rounds[len(out)] == t + 1:
                out.append(1.0 / (1.0 + np.exp(-2.0 * margin)))
        while len(out) < len(rounds):  # boosting that ended early
            out.append(1.0 / (1.0 + np.exp(-2.0 * margin)))
        return np.column_stack(out)

    def forest(self, x: np.ndarray, sizes: list[int], depths: list[int]) -> np.ndarray:
        """Chance of label 1 for each size and, within it, each depth (both rising)."""
        total, out = np.zeros((len(x), len(depths))), []
        for t in range(len(self.first)):
            total += np.column_stack(self.walk(x, t, depths))
            if t + 1 in sizes:
                out.append(total / (t + 1))
        return np.concatenate(out, axis=1)


def scored(df: DataFrame, features: list[str], label: str, trees: Trees, kind: str, axes: list[list[int]]) -> DataFrame:
    """(candidate, label, score): a row of ``df`` for every candidate, candidates numbered in the order of the axes' product."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for k in range(0, len(frame), ROWS):
                part = frame.iloc[k:k + ROWS]
                x = part[features].to_numpy(float)
                scores = own.boosted(x, axes[0]) if kind == "gbt" else own.forest(x, axes[0], axes[1])
                yield pd.DataFrame({"label": part["__label"].to_numpy(), "scores": list(scores)})

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("__label")).mapInPandas(run, "label int, scores array<double>")
    return rows.select("label", F.posexplode("scores").alias("candidate", "score"))


def groups(kind: str, grid: list[dict]) -> list[tuple[dict, list[list[int]], list[dict]]]:
    """(parameters of the one fit, rising values of the nested axes, the candidates in scoring order)."""
    nested = NESTED[kind]
    together: dict[tuple, list[dict]] = {}
    for params in grid:
        together.setdefault(tuple(sorted((k, v) for k, v in params.items() if k not in nested)), []).append(params)
    out = []
    for rest, members in together.items():
        axes = [sorted({p[a] for p in members}) for a in nested if a in members[0]]
        names = [a for a in nested if a in members[0]]
        order: list[dict] = [dict(rest)]
        for name, values in zip(names, axes):
            order = [o | {name: v} for o in order for v in values]
        out.append((dict(rest) | {n: v[-1] for n, v in zip(names, axes)}, axes, order))
    return out


def fold_aucs(train: DataFrame, held: DataFrame, features: list[str], kind: str, label: str, group, fit) -> list[tuple[dict, float]]:
    """AUC on the held-out fold of every candidate that one fit serves; ``fit(train, params)`` returns the fitted model."""
    params, axes, order = group
    model = fit(train, params)
    trees = Trees(train.sparkSession, model, kind == "gbt")
    if kind == "random_forest" and len(axes) == 1:  # one of the two axes is not searched
        axes = [axes[0], [params.get("maxDepth", 30)]] if "numTrees" in order[0] else [[len(trees.first)], axes[0]]
    found = {r["candidate"]: r["auc"] for r in auc_of(scored(held, features, label, trees, kind, axes), "label", "score", by=["candidate"]).collect()}
    return [(p, found[i]) for i, p in enumerate(order)]
