"""N-gram Jaccard join with count-vector R-trees.

A text's set holds the 64-bit hashes of its distinct shingles of ``k`` words.  Its count vector says how many hashes fall
into each of G equal ranges of the hash space.  The overlap of two sets is at most the sum of the coordinate minima of their vectors; in an
R-tree over vectors the same holds for a query and the coordinate maxima of a node.  What the bound leaves is verified on the sets.

Where the join runs.  Texts with equal sets are one class from the start.  A class meets others in buckets: one for each of
b pairs of minimum hashes, b chosen so that two sets at the threshold share no bucket with probability at most ``MISS``.

1. The first buckets are dealt into chunks of about ``CHUNK`` classes; each chunk is joined through its tree, with the sets at hand, and only a
   spanning forest of its links leaves.  Two independent dealings connect a group of near copies, however large, before any complete comparison.
2. Buckets that still hold different components are joined completely, the first ones, then, after new components, the rest: cells of two chunks of about
   ``CELL`` units of ``UNIT`` shingles, tree by tree, leaving out pairs already in one component and pairs that met in an earlier bucket.  What
   the bound lets through is verified in the cell, where the sets are at hand; again only spanning links leave.

So no task holds a bucket, no pair leaves a task unless it joins two components there, and no link between different components is left out.  A row
travels once for every chunk that its chunk has to meet: a large bucket of texts that are near but unlinked costs its size times its size in chunks.

Defined cases: texts without words have the empty set and link with nothing; a text of fewer words is one shingle; a row
with a null id takes the name of its class's smallest id, if there is one; rows are told apart by their sets, and classes with one smallest id are one node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, small_batches, text_slices, tidy, utf8
from .components import components

MISS = 1e-12
CHUNK = 48
CELL = 2048
UNIT = 256
MOST_BITS = 26
FIRST_BUCKETS = 2
COARSE = 64
FINEST = 4096
LEAF = 8
SLICE_BYTES = 1 << 20
KNOWN_WORDS = 120_000
STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = min(k, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    for j in range(m):
        h = mix(h * STEP + w[j:len(w) - m + 1 + j])
    return np.unique(h)


def bands_for(threshold: float) -> int:
    """Pairs of minima after which sets at the threshold have met but for a chance of ``MISS``."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold ** 2))) if threshold < 1 else 1


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def bucket_keys(s: np.ndarray, bands: int) -> np.ndarray:
    """One key for every pair of minimum hashes."""
    spread = s ^ (s >> np.uint64(32))
    factors = _multipliers(2 * bands)
    low = np.array([(spread * f).min() for f in factors]) if len(s) > 4096 else (factors[:, None] * spread).min(axis=1)
    return mix(mix(low[0::2]) + low[1::2] + np.arange(bands, dtype=np.uint64)).view(np.int64)


def vector_of(s: np.ndarray) -> bytes:
    """Counts over G ranges of the hash space, G about half the set's size; the first byte is the size of a count."""
    bits = min(FINEST, max(COARSE, len(s) // 2)).bit_length() - 1
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


class Point:
    """A class in a tree: its size, its vector, folded to any coarser G on demand, and, where at hand, its set."""

    def __init__(self, rep, n, vector, component=None, keys=None, shingles=None):
        self.rep, self.n, self.component, self.keys = rep, n, component, keys
        fine = np.frombuffer(vector, f"<u{vector[0]}", offset=1).astype(np.int32)
        self.folded = {len(fine): fine}
        self.coarse = self.fold(COARSE)
        self.fine = len(fine)
        self.shingles = np.frombuffer(shingles, np.uint64) if shingles is not None else None

    def fold(self, size: int) -> np.ndarray:
        if size not in self.folded:
            self.folded[size] = self.folded[max(self.folded)].reshape(size, -1).sum(axis=1)
        return self.folded[size]


class Threshold:
    """Two sets link when share[1] * overlap >= share[0] * union, in whole numbers."""

    def __init__(self, share: tuple[int, int]):
        self.up, self.down = share

    def reached(self, overlap, sizes):
        return (self.up + self.down) * overlap >= self.up * sizes

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1) if len(large) else np.zeros(0, np.int64)
        return bool(len(a) and len(b) and self.reached(int((large[at] == small).sum()), len(a) + len(b)))


class CountTree:
    """A packed R-tree over count vectors: points are sorted by size, leaves hold ``LEAF`` points, and every node
    keeps its coordinate maxima and its smallest size.  Leaves check the finest vectors that both sides have."""

    def __init__(self, points: list[Point], threshold: Threshold):
        self.points = sorted(points, key=lambda p: p.n)
        self.threshold = threshold
        self.vectors = np.array([p.coarse for p in self.points])
        self.sizes = np.array([p.n for p in self.points])
        self.fines = np.array([p.fine for p in self.points])
        self.levels = []
        top, least = self.vectors, self.sizes
        while len(top) > 1:
            cut = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut)
            self.levels.append((top, least))
        self.matrices: dict[tuple, tuple] = {}

    def _matrix(self, fine: int, size: int):
        """Vectors of the points with G = ``fine``, folded to ``size``, and each point's row there."""
        if (fine, size) not in self.matrices:
            on = np.flatnonzero(self.fines == fine)
            row = np.full(len(self.points), -1)
            row[on] = np.arange(len(on))
            self.matrices[fine, size] = np.array([self.points[i].fold(size) for i in on.tolist()]), row
        return self.matrices[fine, size]

    def near(self, q: Point, allowed: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the (allowed) points whose bounds with ``q`` reach the threshold."""
        if not self.points:
            return np.zeros(0, np.int64)
        at = np.zeros(1, np.int64)
        for height in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[height]
            at = at[self.threshold.reached(np.minimum(top[at], q.coarse).sum(axis=1), least[at] + q.n)]
            below = len(self.levels[height - 1][0]) if height else len(self.points)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        if allowed is not None:
            at = at[allowed[at]]
        at = at[self.threshold.reached(np.minimum(self.vectors[at], q.coarse).sum(axis=1), self.sizes[at] + q.n)]
        found = []
        for fine in np.unique(self.fines[at]).tolist():
            size = min(fine, q.fine)
            matrix, row = self._matrix(fine, size)
            own = at[self.fines[at] == fine]
            found.append(own[self.threshold.reached(np.minimum(matrix[row[own]], q.fold(size)).sum(axis=1), self.sizes[own] + q.n)])
        return np.concatenate(found) if found else at


class Forest:
    """Union-find over a chunk; keeps the links that joined something."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _sketch(docs: DataFrame, row_id: str, text: str, k: int, bands: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE_BYTES):
                sets = [shingle_set(t, k, hashes) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([bucket_keys(s, bands) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["id", "n", "digest", "keys"])

    return docs.select(F.col(row_id).cast("long"), utf8(text)).mapInArrow(tidy(run), "id long, n long, digest binary, keys array<long>")


class Filter:
    """A Bloom filter over ids of at most 2**MOST_BITS bits (8 MB), whatever the number of ids; it only spares work, rows it lets
    through in error are removed by a join."""

    def __init__(self, ids: DataFrame, column: str):
        bits = max(10, min(MOST_BITS, (16 * ids.count()).bit_length()))
        self.shift = 64 - bits
        spots = ids.select(F.explode(F.array(*[F.shiftrightunsigned(h, self.shift) for h in self.hashes(column)])).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("v")).collect()
        self.words = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        self.words[[r["w"] for r in words]] = np.array([r["v"] for r in words], np.int64).view(np.uint64)

    @staticmethod
    def hashes(column: str) -> list:
        return [F.xxhash64(F.col(column), F.lit(i)) for i in range(3)]

    def holds(self, hashes: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(hashes[0]), bool)
        for h in hashes:
            at = h.view(np.uint64) >> np.uint64(self.shift)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _sets(docs: DataFrame, k: int, wanted: Filter) -> DataFrame:
    """(digest, n, vector, shingles) of the rows (id, body) whose id the filter holds; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        hashes = WordHashes()
        for every in batches:
            keep = shared.value.holds([every.column(i).to_numpy() for i in range(3)])
            whole = every.select([3]).filter(pa.array(keep))
            for batch in text_slices(whole, 0, SLICE_BYTES):
                sets = [shingle_set(t, k, hashes) for t in batch.column(0).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([vector_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["digest", "n", "vector", "shingles"])

    hashed = docs.where("id is not null").select(*[h.alias(f"h{i}") for i, h in enumerate(Filter.hashes("id"))], "body")
    return hashed.mapInArrow(tidy(run), "digest binary, n long, vector binary, shingles binary")


def _groups(batches, key_columns: int):
    """Runs of rows with equal leading columns, from batches sorted by them; runs are chunks of bounded size."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            values = tuple(row.values())
            if values[:key_columns] != key:
                if rows:
                    yield key, rows
                key, rows = values[:key_columns], []
            rows.append(row)
    if rows:
        yield key, rows


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batches(pairs, size: int = 20_000):
    held = []
    for pair in pairs:
        held.append(pair)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], schema=EDGES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], schema=EDGES)


def _join_chunks(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Spanning links of every chunk (key, salt) whose rows carry sets."""
    def links(batches):
        for _, rows in _groups(batches, 2):
            points = [Point(r["rep"], r["n"], r["vector"], shingles=r["shingles"]) for r in rows]
            tree, forest = CountTree(points, threshold), Forest()
            for q in tree.points:
                for p in (tree.points[i] for i in tree.near(q).tolist()):
                    if forest.root(p.rep) != forest.root(q.rep) and threshold.linked(p.shingles, q.shingles):
                        forest.join(p.rep, q.rep)
            for node in list(forest.parent):
                if forest.root(node) != node:
                    yield forest.root(node), node

    return rows.mapInArrow(tidy(lambda batches: _edge_batches(links(batches))), "a long, b long")


def _join_cells(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Links between different components, a spanning forest of those in each cell (key, i, j) of two chunks of a bucket."""
    def links(batches):
        for (_, i, j), rows in _groups(batches, 3):
            points = [(r["chunk"], Point(r["rep"], r["n"], r["vector"], r["component"], np.array(r["keys"][:rows[0]["band"]]), r["shingles"])) for r in rows]
            tree, forest = CountTree([p for c, p in points if c == j], threshold), Forest()
            reps, components = np.array([p.rep for p in tree.points]), np.array([p.component for p in tree.points])
            keys = np.array([p.keys for p in tree.points])
            for c, q in points:
                if c != i:
                    continue
                allowed = components != q.component
                if i == j:
                    allowed &= reps < q.rep
                if len(q.keys) and len(keys):
                    allowed &= ~(keys == q.keys).any(axis=1)  # those met in an earlier bucket
                if allowed.any():
                    for p in (tree.points[k] for k in tree.near(q, allowed).tolist()):
                        if forest.root(p.component) != forest.root(q.component) and threshold.linked(p.shingles, q.shingles):
                            forest.join(p.component, q.component)
                            yield p.component, q.component

    return rows.mapInArrow(tidy(lambda batches: _edge_batches(links(batches))), "a long, b long")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys together and in order; a key's rows are a chunk of bounded size."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _cells(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, once for every cell (i, j) they take part in.

    A row weighs one unit for every ``UNIT`` shingles begun, so that a cell is bounded in bytes.  Components of at most ``CELL`` units of a bucket
    share chunks; a larger one has chunks of its own, which meet all others but never one another.  So a bucket that is one large component and little else costs its size, not its square.
    """
    sizes = placed.groupBy("key", "component").agg(F.sum(F.ceil(F.col("n") / UNIT)).alias("c"))
    large = F.col("c") > CELL
    buckets = (sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.when(large, 0).otherwise(F.col("c"))).alias("small"),
                                        F.collect_list(F.when(large, F.struct("component", F.ceil(F.col("c") / CELL).alias("parts")))).alias("large"))
               .filter("kinds > 1").withColumn("shared", F.ceil(F.col("small") / CELL)).select("key", "shared", "large"))
    rows = placed.join(buckets, "key")
    mine = F.get(F.filter("large", lambda x: x["component"] == F.col("component")), F.lit(0))

    def name(component, part):
        return F.concat_ws(":", component.cast("string"), part.cast("string"))

    shared = F.when(F.col("shared") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("shared") - 1), lambda k: name(F.lit("s"), k)))
    others = F.flatten(F.transform(F.filter("large", lambda x: x["component"] != F.col("component")),
                                   lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda k: name(x["component"], k))))
    chunk = F.when(mine.isNull(), name(F.lit("s"), F.pmod(F.xxhash64("component"), F.col("shared")))).otherwise(
        name(F.col("component"), F.pmod(F.xxhash64("rep"), mine["parts"])))
    met = F.concat(F.coalesce(shared, F.array().cast("array<string>")), others)
    return (rows.withColumn("chunk", chunk).withColumn("other", F.explode(met))
            .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "band", "rep", "component", "digest"))


def join(docs: DataFrame, k: int = 4, share: tuple[int, int] = (85, 100), row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n_shingles, component_id) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    threshold, bands = Threshold(share), bands_for(share[0] / share[1])
    sketch = shared_table(_sketch(docs, row_id, text, k, bands), "shingle-sketch")
    classes = shared_table(sketch.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
                           .filter("rep is not null"), "shingle-classes")
    keyed = classes.select("rep", "digest", "n", "keys", F.posexplode("keys").alias("band", "key"))
    # of buckets that hold the same classes, recognised by their number and 128 bits, the first says it all
    buckets = (keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.min("band").alias("first"),
                                        *[F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in (1, 2)]).filter("low < high"))
    shared = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("first", "key")).alias("b")).select("b.key", "m")
    met = shared_table(keyed.join(shared, "key").select("key", "band", "rep", "digest", "n", "m"), "shingle-met")
    wanted = Filter(met.select("rep").distinct(), "rep")
    sets = _sets(docs.select(F.col(row_id).cast("long").alias("id"), utf8(text).alias("body")), k, wanted)
    # one row per class; of what the filter lets through in error nothing has a class in a bucket
    sets = sets.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "vector", "shingles")])
    sets = shared_table(sets.join(met.select("digest").distinct(), "digest", "left_semi"), "shingle-sets")

    first = met.filter(F.col("band") < FIRST_BUCKETS).withColumn("salt", F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("m") / CHUNK)))
    chunks = _dealt(first.drop("n").join(sets, "digest").select("key", "salt", "rep", "n", "vector", "shingles"), "key", "salt")
    edges = shared_table(_join_chunks(chunks, threshold), "shingle-links")
    named = components(edges)

    slim = sets.join(classes.select("digest", "keys"), "digest")
    for own in (F.col("band") < FIRST_BUCKETS, F.col("band") >= FIRST_BUCKETS):
        part = met.filter(own)
        placed = part.join(named, part["rep"] == named["node"], "left").withColumn("component", F.coalesce("component", "rep"))
        cells = _dealt(_cells(placed).join(slim, "digest").select("key", "i", "j", "chunk", "band", "rep", "component", "n", "vector", "keys", "shingles"), "key", "i", "j")
        edges = edges.union(shared_table(_join_cells(cells, threshold), "shingle-links"))
        named = components(edges)

    found = (sketch.select("id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
             .join(named, F.col("rep") == F.col("node"), "left"))
    return found.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that link, directly or not, with a document of smaller id.

    An id stays if any of its rows is the smallest of its component; rows that repeat an id and all columns stay once; rows without an id stay.
    """
    found = join(docs, k, share, row_id, text)
    per_id = (found.filter(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias("__id"))
              .agg(F.max((F.col("component_id") == F.col(row_id)).cast("int")).alias("first"), F.count("*").alias("rows")))
    per_id = shared_table(per_id.filter("first = 0 or rows > 1"), "near-copies")
    here = F.col(row_id).cast("long") == F.col("__id")
    single = docs.join(per_id.select("__id"), here, "left_anti")
    repeated = docs.join(per_id.filter("first = 1").select("__id"), here, "left_semi").dropDuplicates()
    return single.unionByName(repeated).select(*docs.columns)
