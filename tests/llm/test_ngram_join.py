import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ngram_join
from cohortlens.llm.components import components


def shingles(text, k):
    words = (text or "").encode().translate(ngram_join._LOWER).split()
    m = min(k, len(words))
    return {tuple(words[i:i + m]) for i in range(len(words) - m + 1)} if words else set()


def brute(rows, k, up, down):
    """Component names as the operator defines them, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] == sets[b]
        if same or sets[a] and sets[b] and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(least.get(root(i), own), own)
    return sorted(((own, len(sets[i]), least.get(root(i)) if sets[i] else own) for i, (own, _) in enumerate(rows)), key=str)


def joined(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, **options).collect()), key=str)


def test_awkward_rows(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    clash = awkward.withColumn("n", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("rep", F.lit(2))
    assert joined(clash, k=4, share=(85, 100)) == brute(rows, 4, 85, 100)
    assert joined(empty) == []


def family(seed, n, length, changes):
    """Copies of one text, each a few words away from an earlier one: chains as well as cliques."""
    r = random.Random(seed)
    out = [[f"v{r.randrange(300)}" for _ in range(length)]]
    for _ in range(n - 1):
        text = list(out[r.randrange(max(0, len(out) - 8), len(out))])
        for _ in range(r.randint(0, changes)):
            text[r.randrange(length)] = f"u{r.randrange(10_000)}"
        out.append(text)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("chunk, cell", [(48, 512), (3, 4)])
def test_chains_cliques_and_thresholds(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "CELL", cell)
    texts = family(1, 60, 90, 3) + family(2, 60, 40, 1) + family(3, 40, 12, 1) + [" ".join(f"z{i}" for i in range(7))] * 30
    random.Random(9).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, up in ((4, 85), (5, 80)):
        assert joined(df, k=k, share=(up, 100)) == brute(rows, k, up, 100)


def test_a_group_beyond_one_chunk_is_one_component(spark):
    base = [f"q{i}" for i in range(200)]
    texts = []
    for i in range(260):
        text = list(base)
        text[(7 * i) % 200] = f"own{i}"
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {c for _, _, c in joined(df)} == {0}


def test_the_bound_never_drops_a_pair():
    r = np.random.default_rng(6)
    threshold = ngram_join.Threshold((85, 100))
    for _ in range(300):
        n = int(r.integers(1, 900))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.97], r.integers(0, 1 << 63, int(0.03 * n)).astype(np.uint64)]))
        if not len(b):
            continue
        pa, pb = (ngram_join.Point(i, len(s), ngram_join.vector_of(s)) for i, s in enumerate((a, b)))
        if threshold.linked(a, b):
            assert ngram_join.CountTree([pb], threshold).near(pa).tolist() == [0]


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(7)
    threshold = ngram_join.Threshold((80, 100))
    pool = [np.unique(r.integers(0, 1 << 63, int(r.integers(20, 400))).astype(np.uint64) * np.uint64(2)) for _ in range(12)]
    sets = [s[r.random(len(s)) < r.uniform(0.8, 1)] for s in pool for _ in range(8)]
    points = [ngram_join.Point(i, len(s), ngram_join.vector_of(s), shingles=s.tobytes()) for i, s in enumerate(sets)]
    tree = ngram_join.CountTree(points, threshold)
    for q in points:
        scanned = {p.rep for p in points if threshold.linked(p.shingles, q.shingles)}
        found = {tree.points[i].rep for i in tree.near(q).tolist()}
        assert scanned <= found

        def allows(p):
            size = min(p.fine, q.fine)
            return threshold.reached(np.minimum(p.fold(size), q.fold(size)).sum(), p.n + q.n)

        assert {p.rep for p in points if allows(p)} == found


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(200 + i, 200) for i in range(1, 20)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{200 + i: 200 for i in range(20)}}


def test_one_document_of_each_group_stays(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    first = {own for own, _, c in brute(rows, 5, 80, 100) if own == c}
    clash = awkward.withColumn("n", F.lit("x")).withColumn("rows", F.lit(1))
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in first if i is not None)
    assert ids.count(None) == sum(own is None for own, _ in rows)
    assert ngram_join.one_of_each(empty).count() == 0


def test_only_spanning_links_leave_a_task(spark, monkeypatch):
    """A large group of texts that are near, mostly unlinked: what leaves the tasks grows with its size, not with its square."""
    made = {}
    written = ngram_join.shared_table

    def counted(df, name):
        out = written(df, name)
        if name == "shingle-links":
            made["links"] = made.get("links", 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "shared_table", counted)
    left = {}
    for n in (150, 450):
        r = random.Random(4)
        base = [f"q{i}" for i in range(300)]
        texts = []
        for i in range(n):
            text = list(base)
            for _ in range(5):
                text[r.randrange(300)] = f"own{r.randrange(10 ** 6)}"
            texts.append(" ".join(text))
        made.clear()
        rows = list(enumerate(texts))
        assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=5, share=(80, 100)) == brute(rows, 5, 80, 100)
        left[n] = made["links"]
    assert left[450] <= 3 * left[150] + 450 and left[450] < 4 * 450


def test_chance_to_miss_a_bucket_is_as_computed():
    """Pairs at the threshold, few bands: the share without a common bucket is the one that the number of bands is computed from."""
    r = np.random.default_rng(3)
    bands, missed, pairs = 3, 0, 1500
    for _ in range(pairs):
        both, own = r.integers(0, 1 << 64, 160, np.uint64), r.integers(0, 1 << 64, 40, np.uint64)  # Jaccard 0.8
        a, b = np.unique(np.concatenate([both, own[:20]])), np.unique(np.concatenate([both, own[20:]]))
        missed += not (ngram_join.bucket_keys(a, bands) == ngram_join.bucket_keys(b, bands)).any()
    want = (1 - 0.8 ** 2) ** bands
    assert abs(missed / pairs - want) < 4 * (want * (1 - want) / pairs) ** 0.5
