"""Deterministic splits (E23, E24, W8, M6 folds).

Order = seeded md5 hash of the row id (identical across engines and
partitionings, unlike ``rand(seed)``).  Exact sizes come from cut-off hashes: the k-th
smallest hash of a stratum is found by counting hash prefixes and reading the one
prefix that holds rank k; every row then compares its own hash with a literal, so
the table itself is never sorted or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import SEED, hash_key

HASH_BITS = 60
STEP_BITS = 12
READ_ROWS = 20_000


def cutoffs(df: DataFrame, id_col: str, shares: list[float], seed: int = SEED, stratify: str | None = None) -> dict:
    """{stratum: [(hash, id) of the last row of each share, None for a share of no rows]}: the first ceil(share·n) rows of
    the stratum's hash order.  Strata are labels; one row per stratum and hash prefix reaches the driver, and at most
    ``READ_ROWS`` (hash, id) rows per cut-off."""
    by = F.col(stratify) if stratify else F.lit(0)
    rows = df.select(by.alias("s"), hash_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))

    def counted(part: DataFrame, shift: int) -> dict:
        out: dict = {}
        for r in part.groupBy("s", F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            out.setdefault(r["s"], {})[r["p"]] = r["n"]
        return out

    def place(counts: dict, rank: int, shift: int) -> tuple:
        """(shift, prefix that holds the rank, rank inside it, its rows)."""
        for p in sorted(counts):
            if rank <= counts[p]:
                return shift, p, rank, counts[p]
            rank -= counts[p]
        raise ValueError("rank beyond the rows")

    def inside(s, shift, p) -> Column:
        return F.col("s").eqNullSafe(F.lit(s)) & (F.shiftright("h", shift) == F.lit(p))

    shift = HASH_BITS - STEP_BITS
    first = counted(rows, shift)
    at = {(s, k): place(c, math.ceil(sum(c.values()) * share), shift)
          for s, c in first.items() for k, share in enumerate(shares) if math.ceil(sum(c.values()) * share) > 0}
    while shift > 0 and any(a[0] == shift and a[3] > READ_ROWS for a in at.values()):
        big = {(s, a[1]) for (s, _), a in at.items() if a[0] == shift and a[3] > READ_ROWS}
        finer = counted(rows.where(_any(inside(s, shift, p) for s, p in big)), shift - STEP_BITS)
        for (s, k), (sh, p, rank, n) in at.items():
            if sh == shift and n > READ_ROWS:
                at[s, k] = place({q: c for q, c in finer[s].items() if q >> STEP_BITS == p}, rank, shift - STEP_BITS)
        shift -= STEP_BITS
    spots = {(s, a[0], a[1]) for (s, _), a in at.items()}
    held: dict = {}
    if spots:
        for r in rows.where(_any(inside(*x) for x in spots)).distinct().collect():
            for x in spots:
                if x[0] == r["s"] and r["h"] >> x[1] == x[2]:
                    held.setdefault(x, []).append((r["h"], r["i"]))
    cuts = {s: [None] * len(shares) for s in first}
    for (s, k), (sh, p, rank, _) in at.items():
        own = sorted(held[s, sh, p])
        cuts[s][k] = own[min(rank, len(own)) - 1]
    return cuts


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _within(id_col: str, seed: int, cuts: dict, k: int, stratify: str | None) -> Column:
    """Whether a row stands at or before its stratum's k-th cut-off."""
    h, out = hash_key(id_col, seed), F.lit(False)
    for s, own in cuts.items():
        if own[k] is not None:
            here = F.col(stratify).eqNullSafe(F.lit(s)) if stratify else F.lit(True)
            out = out | (here & ((h < own[k][0]) | ((h == own[k][0]) & (F.col(id_col) <= F.lit(own[k][1])))))
    return F.coalesce(out, F.lit(False))


def train_test_split(df: DataFrame, id_col: str, test_frac: float = 0.2, seed: int = SEED,
                     stratify: str | None = None, method: str = "exact") -> DataFrame:
    """Adds ``split`` ('train'/'test').  Exact: the first
    ceil(test_frac·n) rows of the hash order (per stratum) are test, as
    sklearn sizes them.  ``method='fraction'`` cuts the hash at test_frac
    instead (size within sampling error)."""
    if method == "fraction":
        test = hash_key(id_col, seed) / F.lit(float(2 ** HASH_BITS)) < test_frac
    else:
        test = _within(id_col, seed, cutoffs(df, id_col, [test_frac], seed, stratify), 0, stratify)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """M6 folds: the hash order (per stratum) cut into k parts of equal size."""
    cuts = cutoffs(df, id_col, [j / k for j in range(1, k)], seed, stratify)
    after = [(~_within(id_col, seed, cuts, j, stratify)).cast("int") for j in range(k - 1)]
    return df.withColumn("fold", sum(after, F.lit(0)).cast("int"))


def growing_subsets(df: DataFrame, id_col: str, fractions=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
                    seed: int = SEED) -> DataFrame:
    """Rows of the size-f learning-curve subset, for each f (nested:
    a row in the f subset is in every larger one)."""
    cuts = cutoffs(df, id_col, list(fractions), seed)
    sizes = [F.when(_within(id_col, seed, cuts, k, None), F.lit(float(f))) for k, f in enumerate(fractions)]
    return df.withColumn("fraction", F.explode(F.filter(F.array(*sizes), lambda f: f.isNotNull())))


def subset_since(df: DataFrame, id_col: str, fractions, seed: int = SEED, out: str = "since") -> DataFrame:
    """The smallest of the (rising) fractions whose subset holds the row: ``growing_subsets`` as one column, without copies of rows."""
    cuts = cutoffs(df, id_col, list(fractions), seed)
    return df.withColumn(out, F.coalesce(*[F.when(_within(id_col, seed, cuts, k, None), F.lit(float(f))) for k, f in enumerate(fractions)]))


def split_sql_expr(id_sql: str, frac: float = 0.2, seed: int = SEED, partition: str | None = None) -> str:
    from ..functions.ordering import hash_key_sql
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"CASE WHEN row_number() OVER ({part}ORDER BY {hash_key_sql(id_sql, seed)}, {id_sql}) <= "
            f"ceil(count(*) OVER ({part.strip()}) * {frac}) THEN 'test' ELSE 'train' END")
