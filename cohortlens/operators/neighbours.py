"""Exact k nearest neighbours (J8) and local outlier factors.

Points are dealt to cells: the leaves of a k-d tree over rows of lowest hash (``Boxes``), or, where points have many components and boxes rule out nothing, the
nearest of a few pivots (``Pivots``).  A cell is kept in blocks of at most about ``BLOCK_ROWS`` points (``WIDE_ROWS``), so that a heavy cell is many blocks.  The
k-th distance inside a point's own block bounds its true k-th distance r.  Only a cell whose box is within r (by the triangle inequality: whose pivot p and radius R
give d(x, p) - R <= r) can hold a closer point; a point travels only to the cells that it cannot rule out, packed with the others of its block that go there, and
of each block at most its k nearest within r leave.  Cells are as large as a task may hold, so that few points lie near a border: the copies of a point do not grow with the table.
A block lies in the order of a k-d tree of its own; runs of ``RUN`` points whose box is too far from the points that ask are not looked at.
Pairs are sifted by one matrix product with its rounding allowed for; only those that it cannot rule out get a distance.  Nothing is approximate and no candidate count is fixed.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK_ROWS, WIDE_ROWS, WIDE = 16384, 8192, 16
SAMPLE = 64  # rows a cell, from which the k-d tree is made
RUN = 256
AT_ONCE = 64
SLACK = 1e-12  # of the squared lengths: many times the rounding of a product of some thousand components

NEIGHBOURS = pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("dist", pa.float64())])


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(-1, dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so that equal points are at 0 and equal differences at equal distances."""
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), AT_ONCE):
        out[k:k + AT_ONCE] = np.sqrt(((a[k:k + AT_ONCE, None, :] - b[None, :, :]) ** 2).sum(axis=-1))
    return out


def _squares(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """Squared distances by one matrix product, at most (``sign`` -1) or at least (1) the true ones."""
    grow = 1.0 + sign * SLACK
    out = a @ b.T
    out *= -2.0
    out += ((a * a).sum(axis=1) * grow)[:, None]
    out += (b * b).sum(axis=1) * grow
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which every ``RUN`` lie together."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= RUN:
            out.append(own)
            continue
        half = -(-len(own) // (2 * RUN)) * RUN
        parted = own[np.argpartition(x[own, int(np.ptp(x[own], axis=0).argmax())], half - 1)]
        todo += [parted[half:], parted[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distance of each box (low, high) to each of the others; a point is a box."""
    out = np.zeros((len(low), len(lows)))
    for j in range(low.shape[1]):
        gap = np.maximum(lows[:, j] - high[:, j, None], low[:, j, None] - highs[:, j])
        np.maximum(gap, 0.0, out=gap)
        out += gap * gap
    return out


def _near_rows(x: np.ndarray, most: float, y: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray | None:
    """Rows of y in runs that may come within ``most`` of some x; None for all."""
    if not np.isfinite(most):
        return None
    near = ~(_gaps(x.min(axis=0)[None], x.max(axis=0)[None], lows, highs)[0] > most * most * (1 + 1e-9))
    if near.all():
        return None
    return np.concatenate([np.arange(r * RUN, min((r + 1) * RUN, len(y))) for r in np.flatnonzero(near)] or [np.zeros(0, np.int64)])


def _boxes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(y), RUN)
    return np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)


def _nearest(ids: np.ndarray, x: np.ndarray, bound: np.ndarray, held: np.ndarray, y: np.ndarray, k: int):
    """(id, nbr, dist) of each x's k nearest rows of y (ties by id) within its bound, itself left out."""
    lows, highs = _boxes(y)
    for i in range(0, len(x), 2 * AT_ONCE):
        own = slice(i, i + 2 * AT_ONCE)
        rows = _near_rows(x[own], bound[own].max(), y, lows, highs)
        to, who = (y, held) if rows is None else (y[rows], held[rows])
        q, h = np.nonzero(~(_squares(x[own], to, -1) > (bound[own] ** 2 * (1 + 1e-9))[:, None]))
        q, d = q + i, np.concatenate([np.sqrt(((x[q[j:j + (1 << 16)] + i] - to[h[j:j + (1 << 16)]]) ** 2).sum(axis=-1)) for j in range(0, len(q), 1 << 16)] or [np.zeros(0)])
        keep = (d <= bound[q]) & np.isfinite(d) & (ids[q] != who[h])
        q, n, d = q[keep], who[h[keep]], d[keep]
        if len(q) and np.bincount(q - i).max() > k:
            order = np.lexsort((n, d, q))
            q, n, d = q[order], n[order], d[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
            q, n, d = q[keep], n[keep], d[keep]
        yield ids[q], n, d


def _partitioned_kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0.0)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row's distance to its k-th nearest other row of x, whose rows lie in ``_runs``: first among the row's own run, then among the runs within that."""
    out = np.empty(len(x))
    lows, highs = _boxes(x)
    for r in range(0, len(x), RUN):
        run = x[max(0, min(r, len(x) - RUN)):r + RUN]  # the last run may be short: it takes rows of the one before
        for i in range(r, min(r + RUN, len(x)), 2 * AT_ONCE):
            own = slice(i, min(i + 2 * AT_ONCE, r + RUN, len(x)))
            at = np.arange(own.start, own.stop)
            if len(run) > k:
                d = _squares(x[own], run, 1)
                d[np.arange(len(d)), at - max(0, min(r, len(x) - RUN))] = np.inf
                first = _partitioned_kth(d, k)
            else:
                first = np.full(len(at), np.inf)
            rows = _near_rows(x[own], np.sqrt(first.max()) * (1 + 1e-3), x, lows, highs)
            d = _squares(x[own], x if rows is None else x[rows], 1)
            d[np.arange(len(d)), at if rows is None else np.searchsorted(rows, at)] = np.inf
            if not np.isfinite(first).all():
                out[own] = _partitioned_kth(d, k)
                continue
            q, h = np.nonzero(d <= (first * (1 + 1e-3))[:, None])
            order = np.lexsort((d[q, h], q))
            count = np.bincount(q, minlength=len(at))
            last = np.cumsum(count) - count + k - 1
            found = first.copy()
            enough = count >= k
            found[enough] = np.maximum(d[q[order[last[enough]]], h[order[last[enough]]]], 0.0)
            out[own] = np.minimum(found, first)
    out = np.sqrt(out) * (1 + 1e-12)
    return np.where(np.isnan(out), np.inf, out)


class Boxes:
    """Leaves of a k-d tree over a sample; a cell's reach is the box of its points."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.feature, self.at, self.left, self.right, self.cell, self.cells = [], [], [], [], [], 0
        todo = [(np.asarray(sample, float), max(1, cells), -1, False)]
        while todo:
            own, n, parent, right = todo.pop()
            node = len(self.feature)
            for column, value in ((self.feature, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.cell, -1)):
                column.append(value)
            if parent >= 0:
                (self.right if right else self.left)[parent] = node
            spread = np.nan_to_num(own.var(axis=0), nan=0.0, posinf=0.0, neginf=0.0) if n > 1 and len(own) > 1 else np.zeros(1)
            if not spread.max() > 0:
                self.cell[node], self.cells = self.cells, self.cells + 1
                continue
            f = int(spread.argmax())
            values = np.sort(own[:, f])
            cut = values[min(len(values) - 1, len(values) * (n // 2) // n)]
            if cut == values[0]:
                cut = values[values > cut][0]
            low = own[:, f] < cut
            share = min(n - 1, max(1, round(n * low.mean())))
            self.feature[node], self.at[node] = f, float(cut)
            todo += [(own[~low], n - share, node, True), (own[low], share, node, False)]
        self.feature, self.at, self.left, self.right, self.cell = (np.array(c) for c in (self.feature, self.at, self.left, self.right, self.cell))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.feature[at] >= 0)):
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] < self.at[node], self.left[node], self.right[node])
        return self.cell[at], np.zeros(len(x))

    @staticmethod
    def measures(dim: int) -> list:
        return [f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(dim) for n, f in (("low", F.min), ("high", F.max))]

    def measured(self, rows: list, dim: int) -> None:
        self.lows, self.highs = (np.array([[r[f"{n}{i}"] for i in range(dim)] for r in rows], float).reshape(-1, dim) for n in ("low", "high"))

    def may_hold(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether each cell, in the order of ``measured``, may hold a point within each row's bound."""
        out = np.zeros((len(x), len(self.lows)), bool)
        most = bound.max()
        some = np.flatnonzero(~(_gaps(x.min(axis=0)[None], x.max(axis=0)[None], self.lows, self.highs)[0] > most * most * (1 + 1e-9)))
        for i in range(0, len(x), 1024):
            own = slice(i, i + 1024)
            out[own, some] = ~(_gaps(x[own], x[own], self.lows[some], self.highs[some]) > (bound[own] ** 2 * (1 + 1e-9))[:, None])
        return out


class Pivots:
    """Cells around a few rows; a cell's reach is a ball."""

    def __init__(self, sample: np.ndarray):
        self.centres = sample

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.concatenate([_squares(x[i:i + 1024], self.centres, 1).argmin(axis=1) for i in range(0, max(len(x), 1), 1024)])
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=-1))

    @staticmethod
    def measures(dim: int) -> list:
        return [F.max("d").alias("radius")]

    def measured(self, rows: list, dim: int) -> None:
        self.radii, self.live = np.array([r["radius"] for r in rows]), self.centres[[r["cell"] for r in rows]]

    def may_hold(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        reach = (bound[:, None] + self.radii) * (1 + 1e-9) + 1e-9
        return ~(_squares(x, self.live, -1) > reach * reach)


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 20, block_rows: int | None = None) -> DataFrame:
    """(id, nbr, dist, rank): each row's k nearest other rows, ties by id.  Rows without an id or a vector, or with a null component, take no part."""
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    points = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", lambda x: x.isNull()))
    first = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = first["n"], first["dim"] or 0
    wide = dim > WIDE
    block_rows = block_rows or (WIDE_ROWS if wide else BLOCK_ROWS)
    # boxes hold three fifths of a block, so that few of them are cut by the sample's chance into two blocks in one place
    count = max(1, min(isqrt(n), n // block_rows)) if wide else max(1, min(isqrt(n), -(-5 * n // (3 * block_rows))))
    sample = [r["v"] for r in points.orderBy(F.xxhash64("id"), "id").limit(count if wide else count * SAMPLE).collect()]
    places = np.array(sample, dtype=float).reshape(-1, dim)
    dealt = Pivots(places) if wide else Boxes(places, count)

    def assign(batches):
        for b in batches:
            cell, d = dealt.assign(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d)], ["id", "v", "cell", "d"])

    cells = written(points.mapInArrow(assign, "id long, v array<double>, cell int, d double"), "knn-cells")
    sizes = sorted(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *dealt.measures(dim)).collect(), key=lambda r: r["cell"])      # one row per cell
    parts = {r["cell"]: -(-r["n"] // block_rows) for r in sizes}
    if not parts:
        return spark.createDataFrame([], "id long, nbr long, dist double, rank int")
    blocks_of = F.lit([parts.get(c, 0) for c in range(max(parts) + 1)])  # one number per cell
    number = cells.withColumn("part", F.pmod(F.xxhash64("id"), F.get(blocks_of, F.col("cell"))).cast("int"))
    order = [r["cell"] for r in sizes]
    dealt.measured(sizes, dim)

    def block(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), _matrix(t.column("v"), dim)
        together = _runs(x)
        ids, x = ids[together], x[together]
        bound = _kth(x, k) if len(x) > k else np.full(len(x), np.inf)
        return pa.table({"cell": t.column("cell")[:1], "part": t.column("part")[:1], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                         "x": pa.array([x.astype("<f8").tobytes()], pa.binary()), "bound": pa.array([bound.astype("<f8").tobytes()], pa.binary())})

    blocks = written(number.groupBy("cell", "part").applyInArrow(block, "cell int, part int, ids binary, x binary, bound binary"), "knn-blocks")

    def requests(batches):
        """Of each block and each cell that some of its points cannot rule out, these points."""
        for b in batches:
            for row in b.to_pylist():
                ids, x, bound = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["x"], "<f8").reshape(-1, dim), np.frombuffer(row["bound"], "<f8")
                near = dealt.may_hold(x, bound)
                for k in np.flatnonzero(near.any(axis=0)):
                    ask = near[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array([order[k]], pa.int32()), *(pa.array([v[ask].tobytes()], pa.binary()) for v in (ids, x, bound))],
                                                     ["cell", "ids", "x", "bound"])

    asking = (blocks.select("ids", "x", "bound").mapInArrow(requests, "cell int, ids binary, x binary, bound binary")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.get(blocks_of, F.col("cell")) - 1))))
    holding = blocks.select("cell", "part", F.col("ids").alias("held"), F.col("x").alias("y"))

    def nearest(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, held = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["held"], "<i8")
                x, y = (np.frombuffer(row[c], "<f8").reshape(-1, dim) for c in ("x", "y"))
                for own, nbr, d in _nearest(ids, x, np.frombuffer(row["bound"], "<f8"), held, y, k):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(nbr), pa.array(d)], schema=NEIGHBOURS)

    found = asking.join(holding.hint("merge"), ["cell", "part"]).select("cell", "ids", "x", "bound", "held", "y").mapInArrow(nearest, "id long, nbr long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lof(nb: DataFrame) -> DataFrame:
    """Local outlier factor from a (id, nbr, dist, rank) neighbour table:
    k-distance, reach-dist = max(k-dist(nbr), dist), density = 1 / (mean reach + 1e-10), LOF = mean neighbour density / own."""
    kd = nb.groupBy("id").agg(F.max("dist").alias("kdist"))
    r = nb.join(kd.select(F.col("id").alias("nbr"), F.col("kdist").alias("nbr_kdist")), "nbr")
    # a step of its own: the exchanges of the two joins do not lie beside each other
    lrd = written(r.groupBy("id").agg((1.0 / (F.avg(F.greatest("dist", "nbr_kdist")) + 1e-10)).alias("lrd")), "lrd")
    j = nb.join(lrd.select(F.col("id").alias("nbr"), F.col("lrd").alias("nbr_lrd")), "nbr")
    m = j.groupBy("id").agg(F.avg("nbr_lrd").alias("m")).join(lrd, "id")
    return m.select("id", (F.col("m") / F.col("lrd")).alias("lof"))


def lof_outliers(df: DataFrame, features: list[str], id_col: str, k: int = 20, contamination: float = 0.05) -> DataFrame:
    """D14 on columns: (id, lof, is_outlier), the top ``contamination`` share by exact rank."""
    from ..functions.ordering import quantile_dict
    v = df.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    scored = written(lof(written(knn(v, id_col, "_v", k), "knn")), "lof")
    cut = quantile_dict(scored, ["lof"], [1 - contamination])[("lof", round(1 - contamination, 10))]
    return scored.select(F.col("id").alias(id_col), "lof", (F.col("lof") > cut).alias("is_outlier"))
