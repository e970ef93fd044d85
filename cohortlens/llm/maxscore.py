"""Exact top-k by inner product with MaxScore.

Every vector becomes integers; a dimension is a term whose postings are the rows with
a non-zero component.  Candidates are packed into blocks of ``BLOCK_ROWS`` rows, queries into
blocks of about ``QUERY_ROWS``; every query block meets every candidate block once, spread
over (query block, salt) keys, so that neither side is collected or broadcast.  In a
block, a query's terms are ordered by their score bound.  Terms whose bounds together
stay below the current k-th score are non-essential: essential postings are
traversed, the others are probed only for rows that are still competitive.  Each block gives
its k best; a window merges the blocks' rows.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part;
a missing component of a shorter vector counts as zero; equal rows are separate candidates; of several
vectors under one query id the smallest is the query; scores beyond a long are cut to its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 512
SEED_ROWS = 256
LONG = (1 << 63) - 1


def integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): usable rows with floor(scale * x) of every component."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
            .select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")))


def _pack(ids: np.ndarray, lists: pa.ListArray):
    """Rows of ids and a dense matrix in the smallest integer type that holds it."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    matrix = np.zeros((len(ids), dim), np.int64)
    matrix[np.arange(dim) < sizes[:, None]] = flat
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return {"ids": ids.astype("<i8").tobytes(), "m": matrix.astype(kind).tobytes(), "dim": dim, "kind": kind}


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["m"], row["kind"]).astype(np.int64).reshape(len(ids), row["dim"])


PACKED = "ids binary, m binary, dim int, kind string"


def _blocks(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(k, BLOCK_ROWS)
            yield pa.RecordBatch.from_pylist([_pack(part.column(0).to_numpy(zero_copy_only=False), part.column(1))],
                                             pa.schema([("ids", pa.binary()), ("m", pa.binary()), ("dim", pa.int32()), ("kind", pa.string())]))


class Postings:
    """A candidate block: per term, its rows and values and the extreme values."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix[order]
        self.rows = [None if (on := self.matrix[:, d] != 0).all() else np.flatnonzero(on) for d in range(matrix.shape[1])]
        self.high = np.maximum(self.matrix.max(axis=0, initial=0), 0)  # a row without the term scores 0 there
        self.low = np.minimum(self.matrix.min(axis=0, initial=0), 0)
        self.most = max(int(self.high.max(initial=0)), -int(self.low.min(initial=0)))

    def add(self, total: np.ndarray, d: int, weight: int) -> None:
        rows = self.rows[d]
        if rows is None:
            total += weight * self.matrix[:, d]
        else:
            total[rows] += weight * self.matrix[rows, d]

    def top(self, own: int, q: np.ndarray, k: int):
        """(rows, scores) of the block's k best for the query ``q`` with id ``own``."""
        n, dim = self.matrix.shape
        q = np.concatenate([q[:dim], np.zeros(max(0, dim - len(q)), np.int64)])
        if dim and max(int(np.abs(q).max()), 1) * max(self.most, 1) * dim >= 1 << 62:
            return self._wide(own, q, k)
        allowed = self.ids != own
        bound = np.maximum(q * self.high, q * self.low)
        seed = np.flatnonzero(allowed[:SEED_ROWS])
        first = self.matrix[seed] @ q
        floor = int(np.partition(first, len(first) - k)[len(first) - k]) if len(first) >= k else None
        order = np.argsort(bound, kind="stable")  # small bounds first
        sums = np.cumsum(bound[order])
        split = 0 if floor is None else int(np.searchsorted(sums, floor))  # terms before it together stay below the k-th score
        total = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        for d in order[split:]:
            if q[d]:
                self.add(total, d, q[d])
            if self.rows[d] is None:
                seen[:] = True
            else:
                seen[self.rows[d]] = True
        if floor is None or floor <= 0:
            seen[:] = True  # a row outside all essential postings may still compete
        alive = np.flatnonzero(seen & allowed)
        for at in range(split - 1, -1, -1):
            if floor is not None:
                alive = alive[total[alive] + sums[at] >= floor]
            d = order[at]
            if q[d]:
                total[alive] += q[d] * self.matrix[alive, d]
        if floor is not None:
            alive = alive[total[alive] >= floor]
        best = alive[np.lexsort((self.ids[alive], -total[alive]))[:k]]
        return self.ids[best], total[best]

    def _wide(self, own, q, k):
        """Exact integers where a sum could leave 64 bits."""
        q = [int(x) for x in q]
        scored = sorted((-sum(a * int(b) for a, b in zip(q, row)), int(i)) for i, row in zip(self.ids, self.matrix) if i != own)[:k]
        return [i for _, i in scored], [max(-LONG - 1, min(LONG, -s)) for s, _ in scored]


def top_k(df: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for every row for
    which the condition ``queries`` on its id holds; the query's own id is no candidate."""
    rows = integers(df, vec_id, vector, scale)
    asked = rows.filter(queries(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(queries(F.col("id")), 1)).alias("q")).first()
    spread = -(-counts["n"] // (2 * BLOCK_ROWS)) + 8
    groups = -(-counts["q"] // QUERY_ROWS) or 1
    asked = (asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
             .groupBy("g", "salt").agg(F.collect_list(F.struct("id", "v")).alias("asked")))
    blocks = (rows.mapInArrow(_blocks, PACKED).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
              .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    pairs = blocks.join(asked, ["g", "salt"]).select("ids", "m", "dim", "kind", "asked")

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                postings = Postings(*_unpack(row))
                out = {"query_id": [], "vec_id": [], "score": []}
                for ask in row["asked"]:
                    ids, scores = postings.top(ask["id"], np.array(ask["v"], np.int64), k)
                    out["query_id"] += [ask["id"]] * len(ids)
                    out["vec_id"] += list(ids)
                    out["score"] += list(scores)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(score, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
