"""Multivariate outlier detectors (D11 isolation forest, D13 robust
Mahalanobis / MCD, D14 LOF) and the J8 neighbour join.

* Isolation forest: each tree is grown on ≤ 256 rows chosen by a per-tree
  seeded hash (a bounded group), inside ``applyInPandas`` keyed by tree; the
  forest (trees × ≤ 511 nodes) is broadcast and every row is scored by an
  Arrow-batched pandas UDF.
* MCD: random starts on a bounded sample, then C-steps of all finalists at once on the whole table; each step is a few Arrow
  passes (counts by leading bits, then k + k² sums a finalist), and a distance expression built from the k×k inverse on the driver.
* LOF: exact neighbours (``neighbours``), then k-distance, reachability, lrd and LOF as group-bys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import quantile_dict
from ..session import written


def _c(n: int) -> float:
    """Average path length of an unsuccessful BST search on n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(X: np.ndarray, rng, max_depth: int):
    """Array-encoded isolation tree: feat, thr, left, right, size."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))  # noqa: E702
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        li = idx[sub[:, f] < t]
        ri = idx[sub[:, f] >= t]
        left[i] = node(li, depth + 1)
        right[i] = node(ri, depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size


def _grow_forests(df: DataFrame, groups: dict[str, list], id_col: str, n_trees: int, sample_size: int, seed: int) -> dict:
    """Trees of several forests from one scan: group -> (psi, [(feat, thr, left, right, size), ...]).

    ``groups`` names a forest's feature columns (column expressions of doubles); rows where one of them is null are not drawn.  A pool of about
    4 * trees * psi rows per forest, independent of the table's size, is kept by a hash of the id; each of its rows picks its trees by a further
    hash, on the row, and a tree keeps the psi rows of lowest hash."""
    def unif(*cols):       # seeded 64-bit hash -> [0, 1), codegen'd, no strings
        return (F.xxhash64(*cols, F.lit(seed)).cast("double") / F.lit(float(2 ** 64))) + F.lit(0.5)

    def whole(feats):
        ok = feats[0].isNotNull()
        for f in feats[1:]:
            ok = ok & f.isNotNull()
        return ok

    n = df.agg(*[F.count_if(whole(feats)).alias(g) for g, feats in groups.items()]).first().asDict()
    psi = {g: min(sample_size, n[g]) for g in groups}
    picks = []
    for g, feats in groups.items():
        pool = min(1.0, 4.0 * n_trees * psi[g] / max(n[g], 1))
        pool_n = min(n[g], 4 * n_trees * psi[g])
        mine = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t, f=min(1.0, 4.0 * psi[g] / max(pool_n, 1)): unif(F.col("__id"), t.cast("bigint")) < f)
        picks.append(F.when(whole(feats) & (unif(F.col("__id")) < pool), F.struct(F.lit(g).alias("forest"), F.array(*feats).alias("x"), mine.alias("trees"))))
    rows = df.withColumn("__id", F.col(id_col)).select("__id", F.explode(F.array_compact(F.array(*picks))).alias("p"))
    rows = rows.select("__id", "p.forest", "p.x", F.explode("p.trees").alias("tree")).withColumn("_u", unif(F.col("__id"), F.col("tree").cast("bigint")))
    w = Window.partitionBy("forest", "tree").orderBy("_u", "__id")
    sizes = F.create_map(*[v for g in groups for v in (F.lit(g), F.lit(psi[g]))])
    drawn = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sizes[F.col("forest")]).select("forest", "tree", "x")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        fe, th, le, ri, sz = _grow(np.array(pdf["x"].tolist(), float), np.random.default_rng(seed * 100003 + t),
                                   int(math.ceil(math.log2(max(len(pdf), 2)))))
        return pd.DataFrame({"forest": [pdf["forest"].iloc[0]], "tree": [t], "feat": [fe], "thr": [th], "left": [le], "right": [ri], "size": [sz]})

    schema = "forest string, tree long, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>"
    made: dict = {g: (psi[g], []) for g in groups}
    for r in sorted(drawn.groupBy("forest", "tree").applyInPandas(build, schema).collect(), key=lambda r: (r["forest"], r["tree"])):  # ≤ forests × trees × 2·psi nodes
        made[r["forest"]][1].append((np.array(r["feat"]), np.array(r["thr"]), np.array(r["left"]), np.array(r["right"]), np.array([_c(int(v)) for v in r["size"]])))
    return made


def _path_lengths(trees: list, x: np.ndarray) -> np.ndarray:
    """Summed path lengths of rows through all trees."""
    total = np.zeros(len(x))
    for fe, th, le, ri, csz in trees:
        node, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
        active = fe[node] >= 0
        while active.any():
            f = fe[node[active]]
            node[active] = np.where(x[active, f] < th[node[active]], le[node[active]], ri[node[active]])
            depth[active] += 1
            active = fe[node] >= 0
        total += depth + csz[node]
    return total


def isolation_forest(df: DataFrame, features: list[str], id_col: str, n_trees: int = 100, sample_size: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``anomaly_score`` (= -score_samples, higher = more anomalous)
    and ``is_outlier`` (score above the (1-contamination) quantile).  A null counts as its column's median, in the trees as in the scores."""
    fill = quantile_dict(df, features, [0.5])
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(fill[(c, 0.5)]).cast("double"), F.lit(0.0)) for c in features]
    psi, trees = _grow_forests(df, {"all": cols}, id_col, n_trees, sample_size, seed)["all"]
    bc, cn = df.sparkSession.sparkContext.broadcast(trees), _c(psi) or 1.0

    @F.pandas_udf(T.DoubleType())
    def path_score(*values: pd.Series) -> pd.Series:
        own = bc.value
        return pd.Series(np.power(2.0, -_path_lengths(own, np.column_stack([v.to_numpy(dtype=float) for v in values])) / max(len(own), 1) / cn))

    # scores are written once, then cut by exact rank
    scored = written(df.withColumn("anomaly_score", path_score(*cols)), "forest-scores")
    thr = quantile_dict(scored, ["anomaly_score"], [1 - contamination])[("anomaly_score", round(1 - contamination, 10))]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(thr))


def column_forests(df: DataFrame, cols: list[str], id_col: str, n_trees: int = 100, sample_size: int = 256,
                   contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """D11 per column: ``df`` with ``{c}__outlier`` for every column, null where the value is null.

    One scan draws the samples of all columns and one job grows all trees.  A forest on one column is a step function of the value, so a
    column's scores are one binary search in its table of at most 2 * trees * psi steps; all columns are scored in one Arrow pass and cut by one
    quantile call.  Nothing is joined."""
    forests = _grow_forests(df, {c: [F.col(c).cast("double")] for c in cols}, id_col, n_trees, sample_size, seed)
    tables = {}
    for c, (psi, trees) in forests.items():
        edges = np.unique(np.concatenate([th[fe >= 0] for fe, th, *_ in trees] or [np.zeros(0)]))
        # a value on an edge goes right: each step is [edge, next edge)
        at = np.concatenate([[edges[0] - 1.0] if len(edges) else [0.0], edges])
        tables[c] = edges, np.power(2.0, -_path_lengths(trees, at[:, None]) / max(len(trees), 1) / (_c(psi) or 1.0))
    bc = df.sparkSession.sparkContext.broadcast([tables[c] for c in cols])

    @F.pandas_udf("array<double>")
    def scores(*values: pd.Series) -> pd.Series:
        out = []
        for (edges, steps), v in zip(bc.value, values):
            x = v.to_numpy(dtype=float)
            out.append(np.where(np.isnan(x), np.nan, steps[np.searchsorted(edges, x, side="right")]))
        return pd.Series(list(np.column_stack(out)))

    scored = df.withColumn("__scores", scores(*[F.col(c).cast("double") for c in cols]))
    scored = written(scored.select(*df.columns, *[F.when(F.col(c).isNotNull(), F.get("__scores", F.lit(i))).alias(f"{c}__score") for i, c in enumerate(cols)]), "forest-scores")
    cut = quantile_dict(scored, [f"{c}__score" for c in cols], [1 - contamination])
    return scored.select(*df.columns, *[(F.col(f"{c}__score") > F.lit(cut[(f"{c}__score", round(1 - contamination, 10))])).alias(f"{c}__outlier") for c in cols])


def _distance_expr(features: list[str], mu: np.ndarray, inv: np.ndarray):
    d = [F.col(f) - float(mu[i]) for i, f in enumerate(features)]
    terms = []
    k = len(features)
    for i in range(k):
        for j in range(k):
            if inv[i, j] != 0:
                terms.append(d[i] * d[j] * float(inv[i, j]))
    return sum(terms[1:], terms[0])


def _moments(df: DataFrame, features: list[str]):
    k = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    r = df.agg(*aggs).collect()[0]
    n = r["n"]
    mu = np.array([r[f"s{i}"] / n for i in range(k)])
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mu[i] * mu[j]
    return mu, cov


#: Fast MCD: random starts, rows of a group and of the merged sample, candidates that go on to the whole table.
STARTS, GROUP_ROWS, GROUPS, FINALISTS = 500, 300, 5, 10


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees <= x): the regularised incomplete gamma function by its series, or its continued fraction."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 0.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= z / n
            total += term
        return front * total
    b, c = z + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1.0 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - front * h


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _c_step(x: np.ndarray, mu: np.ndarray, cov: np.ndarray, h: int):
    """Mean and covariance of the h rows nearest by (mu, cov), and the determinant."""
    d = x - mu
    near = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d), kind="stable")[:h]
    mu, cov = x[near].mean(axis=0), np.atleast_2d(np.cov(x[near], rowvar=False, bias=True))
    return mu, cov, float(np.linalg.det(cov))


def _sample_starts(x: np.ndarray, share: float, seed: int) -> list[tuple]:
    """The best (mu, cov) of many random starts, refined on groups of the sample, then on the whole sample."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    x = x[rng.permutation(n)]
    parts = np.array_split(x, GROUPS) if n >= 2 * GROUP_ROWS else [x]
    found = []
    for part in parts:
        h = min(len(part), max(k + 1, int(math.ceil(share * len(part)))))
        own = []
        for _ in range(STARTS // len(parts)):
            size = k + 1
            while True:  # a subset with a singular covariance grows
                subset = part[rng.choice(len(part), min(size, len(part)), replace=False)]
                cov = np.atleast_2d(np.cov(subset, rowvar=False, bias=True))
                if size >= len(part) or np.linalg.det(cov) > 0:
                    break
                size += 1
            mu, cov, det = _c_step(part, subset.mean(axis=0), cov, h)
            own.append((*_c_step(part, mu, cov, h),))
        found += sorted(own, key=lambda c: c[2])[:FINALISTS]
    if len(parts) > 1:
        h = max(k + 1, int(math.ceil(share * n)))
        found = [_c_step(x, *_c_step(x, mu, cov, h)[:2], h) for mu, cov, _ in found]
    return [(mu, cov) for mu, cov, _ in sorted(found, key=lambda c: c[2])[:FINALISTS]]


#: Distances are told apart by so many leading bits of their order key, then by so many more a pass, until so few rows are left that their values are read.
FIRST_BITS, MORE_BITS, READ_ROWS = 18, 12, 2048


def _keys(d: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = np.ascontiguousarray(d).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _squares(x: list[np.ndarray], mu: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Squared distances of rows given by columns, by steps of whole columns: the same row has the same distance in every pass."""
    d = [c - m for c, m in zip(x, mu)]
    out = np.zeros(len(x[0]))
    for i in range(len(d)):
        half = 0.5 * inv[i, i] * d[i]
        for j in range(i + 1, len(d)):
            half = half + inv[i, j] * d[j]
        out = out + 2.0 * (d[i] * half)
    return out


def _over_rows(data: DataFrame, features: list[str], fits: list[tuple], schema: str, take) -> DataFrame:
    """What ``take(columns, distances of the rows by every fit)`` says of each batch, as rows of (fit, key, n, ...)."""
    own = [(mu, np.linalg.pinv(cov)) for mu, cov in fits]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))]
                yield from take(x, [_squares(x, mu, inv) for mu, inv in own])

    return data.select(*features).mapInArrow(run, schema)


def _distance_cuts(data: DataFrame, features: list[str], fits: list[tuple], prob: float) -> list[float]:
    """The exact quantile (linear interpolation) of the rows' distances by every fit.  A pass counts the distances by the next bits of their order key within
    the range that holds the rank, so that only counts, and at last a few values, reach the driver."""
    import pyarrow as pa

    def counted(shift: int, inside: list[list[tuple]]):
        """{(fit, key >> shift): rows}, of those whose key begins with one of the fit's (shift, prefix); all, if none is given."""
        def take(x, distances):
            for f, d in enumerate(distances):
                keys = _keys(d[~np.isnan(d)])
                if inside:
                    keep = np.zeros(len(keys), bool)
                    for at, prefix in inside[f]:
                        keep |= (keys >> np.uint64(at)) == np.uint64(prefix)
                    keys = keys[keep]
                if len(keys):
                    k, n = np.unique(keys >> np.uint64(shift), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["fit", "key", "n"])

        rows = _over_rows(data, features, fits, "fit int, key long, n long", take).groupBy("fit", "key").agg(F.sum("n").alias("n")).collect()
        out: list[dict] = [{} for _ in fits]
        for r in rows:
            out[r["fit"]][r["key"] % (1 << 64)] = r["n"]
        return out

    def place(counts: dict, rank: int) -> tuple:
        for k in sorted(counts):
            if rank < counts[k]:
                return k, rank, counts[k]
            rank -= counts[k]
        raise ValueError("rank beyond the rows")

    shift = 64 - FIRST_BITS
    first = counted(shift, [])
    spot, at = [], {}  # of each fit: position between its two ranks; (fit, rank) -> shift, prefix, rank inside it, rows
    for f, counts in enumerate(first):
        pos = (sum(counts.values()) - 1) * prob
        spot.append(pos)
        for rank in {math.floor(pos), math.ceil(pos)}:
            at[f, rank] = (shift, *place(counts, rank)) if counts else (0, None, 0, 0)
    while True:
        shift = max(0, shift - MORE_BITS) if any(s > 0 and n > READ_ROWS for s, _, _, n in at.values()) else 0
        spots = [sorted({(s, p) for (g, _), (s, p, _, _) in at.items() if g == f and p is not None and s > shift}) for f in range(len(fits))]
        if not any(spots):
            break
        finer = counted(shift, spots)
        for (f, rank), (s, prefix, left, n) in at.items():
            if prefix is not None and s > shift:
                at[f, rank] = (shift, *place({k: c for k, c in finer[f].items() if k >> (s - shift) == prefix}, left))

    def value(f: int, rank: int) -> float:
        key = at[f, rank][1]
        if key is None:
            return math.nan
        bits = np.array([key ^ (1 << 63) if key >> 63 else ~key % (1 << 64)], np.uint64)
        return float(bits.view(np.float64)[0])

    out = []
    for f, pos in enumerate(spot):
        low, high = math.floor(pos), math.ceil(pos)
        a, b = value(f, low), value(f, high)
        out.append(a if low == high or a == b else (high - pos) * a + (pos - low) * b)
    return out


def _near_moments(data: DataFrame, features: list[str], fits: list[tuple], cuts: list[float]) -> list[tuple]:
    """Rows, mean and covariance (population) of the rows within each fit's cut: one pass, one row a batch and fit, added up in Spark."""
    import pyarrow as pa
    k = len(features)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    names = [f"s{a}" for a in range(k)] + [f"p{a}_{b}" for a, b in pairs]

    def take(x, distances):
        for f, d in enumerate(distances):
            near = d <= cuts[f]
            if near.any():
                own = [c[near] for c in x]
                sums = [c.sum() for c in own] + [(own[a] * own[b]).sum() for a, b in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([int(near.sum())], pa.int64()), *(pa.array([float(v)]) for v in sums)], ["fit", "n", *names])

    each = _over_rows(data, features, fits, "fit int, n long, " + ", ".join(f"{c} double" for c in names), take)
    got = {r["fit"]: r for r in each.groupBy("fit").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()}
    out = []
    for f in range(len(fits)):
        r = got[f]
        mu = np.array([r[f"s{a}"] / r["n"] for a in range(k)])
        out.append((mu, np.array([[r[f"p{min(a, b)}_{max(a, b)}"] / r["n"] - mu[a] * mu[b] for b in range(k)] for a in range(k)])))
    return out


def _whole_table_steps(data: DataFrame, features: list[str], fits: list[tuple], h: int, n: int, max_iter: int) -> tuple:
    """C-steps of all candidates at once until their determinants stand still: a few passes over the written rows a step."""
    live = [(mu, cov, math.inf) for mu, cov in fits]
    done = []
    for _ in range(max_iter):
        now = [(mu, cov) for mu, cov, _ in live]
        steps = _near_moments(data, features, now, _distance_cuts(data, features, now, h / n))
        after = []
        for (_, _, before), (mu, cov) in zip(live, steps):
            det = float(np.linalg.det(cov))
            (done if abs(before - det) <= 1e-12 * max(abs(det), 1.0) or det <= 0 else after).append((mu, cov, det))
        # candidates that came to the same place go on as one
        live = list({round(math.log(c[2]), 9): c for c in after}.values())
        if not live:
            break
    return min(done + live, key=lambda c: c[2])


def fast_mcd(data: DataFrame, features: list[str], support_fraction: float | None = None, max_iter: int = 10, seed: int = 42) -> dict:
    """Minimum covariance determinant: many random starts on a bounded, hash-chosen sample, the ten best run out on the whole table, then the covariance
    scaled to the normal median and one reweighted step over the rows within the 97.5 percentile of chi-square."""
    data = written(data.select(*[F.col(f).cast("double").alias(f) for f in features]).na.drop(), "mcd-rows")
    n, k = data.count(), len(features)
    if n <= k:
        raise ValueError(f"{n} complete rows do not give a covariance of {k} columns")
    h = min(n, max(k + 1, int(math.ceil(support_fraction * n)) if support_fraction else (n + k + 1) // 2))
    sample = data.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(GROUP_ROWS * GROUPS).collect()
    starts = _sample_starts(np.array([list(r) for r in sample], float), h / n, seed)
    mu, cov, det = _whole_table_steps(data, features, starts, h, n, max_iter)
    raw = {"location": mu, "covariance": cov, "determinant": det, "support": h, "rows": n}
    if det <= 0:  # h rows lie in a plane: their distances say it all
        return raw | {"scale": 1.0}
    d = data.select(*features, _distance_expr(features, mu, np.linalg.inv(cov)).alias("d"))
    scale = quantile_dict(d, ["d"], [0.5])[("d", 0.5)] / chi2_quantile(0.5, k)
    scale = scale if scale > 0 else 1.0
    mu, cov = _moments(d.where(F.col("d") / scale < chi2_quantile(0.975, k)), features)
    return raw | {"scale": scale, "raw_location": raw["location"], "raw_covariance": raw["covariance"], "location": mu, "covariance": cov}


def robust_mahalanobis(df: DataFrame, features: list[str], contamination: float = 0.05, max_iter: int = 10,
                       support_fraction: float | None = None, percentile: float | None = None, fit: dict | None = None) -> tuple[DataFrame, dict]:
    """Squared robust distance of every row by ``fast_mcd``; flagged are the ``contamination`` share with the largest distance, or those above a
    ``percentile`` of it (97.5 in the other form of the check).  Rows with a null have no distance and no flag.  A ``fit`` made before is used as it is."""
    fit = fit or fast_mcd(df, features, support_fraction, max_iter)
    mu, cov = fit["location"], fit["covariance"]
    at = round(percentile / 100.0 if percentile is not None else 1 - contamination, 10)
    out = df.withColumn("robust_distance", _distance_expr(features, mu, np.linalg.pinv(cov)))
    thr = quantile_dict(out.where(F.col("robust_distance").isNotNull()), ["robust_distance"], [at])[("robust_distance", at)]
    return out.withColumn("is_outlier", F.coalesce(F.col("robust_distance") > thr, F.lit(False))), {
        "location": mu.tolist(), "covariance": cov.tolist(), "threshold": thr, "determinant": fit["determinant"], "scale": fit["scale"]}


def classical_mahalanobis(df: DataFrame, features: list[str]) -> DataFrame:
    """D13 single-pass variant: distance with the sample mean/covariance."""
    data = df.na.drop(subset=features)
    mu, cov = _moments(data, features)
    return df.withColumn("mahalanobis_sq", _distance_expr(features, mu, np.linalg.pinv(cov)))
