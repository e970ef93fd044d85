import collections
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from cohortlens.llm import bpe, packing, sharding

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(4)
    for _ in range(200):
        length = r.randint(1, 40)
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows, room = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(room[k], k) for k in range(len(rows)) if room[k] >= sizes[i]]
            if fits:
                best = min(f for f, _ in fits)
                k = next(k for f, k in fits if f == best)
            else:
                k = len(rows)
                rows.append([])
                room.append(length)
            rows[k].append(i)
            room[k] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in got for i in row) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in row) for row in got) == sorted(length - x for x in room)


def test_packed_rows_are_whole_and_lossless(spark, awkward, empty):
    encoded = bpe.encode(awkward.withColumn("pack", F.lit("clash")), PATH)
    whole = collections.Counter((r["doc_id"], bytes(r["ids"])) for r in encoded.collect() if r["ids"])
    out = packing.rows_of(packing.pack(encoded, 2, 50256, length=256, buffer_ids=3000, matrix_rows=4), 2, 256).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        ids, at, cut = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 256 and len(cut) == len(r["doc_ids"]) + 1 and cut[-1] <= 256
        assert (ids[cut[-1]:] == 50256).all() and (at[cut[-1]:] == 0).all()
        for a, z, own, k in zip(cut, cut[1:], r["doc_ids"], r["pieces"]):
            assert at[a:z].tolist() == list(range(z - a))
            pieces[own, k].append(ids[a:z].tobytes())
    assert len({(r["pack"], r["row"]) for r in out}) == len(out)
    for (own, text), n in whole.items():
        for k in range(0, len(text), 512):
            assert pieces[own, k // 512].count(text[k:k + 512]) >= n
    assert sum(len(p) for ps in pieces.values() for p in ps) == sum(len(t) * n for (_, t), n in whole.items())
    assert packing.pack(bpe.encode(empty, PATH), 2, 50256).count() == 0


def test_packed_matrices_written_and_read(spark, awkward, tmp_path):
    matrices = packing.pack(bpe.encode(awkward, PATH), 2, 50256)
    packing.write(matrices, str(tmp_path / "packed"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "packed")).collect())) == sorted(map(str, matrices.collect()))


def check_shards(rows, texts, shards):
    home, slots, load = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] in texts else None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            assert r["size"] == len((text or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text or "").encode())
            assert home.setdefault(text, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return load


def test_shards_of_awkward_rows(awkward, empty):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    rows = sharding.shard_documents(awkward.withColumn("shard", F.lit("x")).withColumn("digest", F.lit(1)), 3).collect()
    assert len(rows) == awkward.count()
    check_shards(rows, texts, 3)
    assert sharding.shard_documents(empty, 3).count() == 0


def test_shards_are_near_equal_and_groups_stay(spark):
    r = random.Random(5)
    texts = ["y" * r.randint(0, 300) + str(r.randrange(900)) for _ in range(2500)] + ["copy"] * 1200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    load = check_shards(sharding.shard_documents(df, 5).collect(), dict(enumerate(texts)), 5)
    assert max(load.values()) - min(load.values()) <= 600


def plain_schedule(sizes, shards):
    """Loads after handing out the groups one by one, each to the least loaded shard, ties by number; and each size's shards in order."""
    load, homes = [0] * shards, collections.defaultdict(list)
    for size in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += size
        homes[size].append(s)
    return load, homes


def test_schedule_against_one_group_at_a_time():
    r = random.Random(9)
    for _ in range(400):
        shards = r.randint(1, 6)
        sizes = [r.choice([1, 2, 3, 7, 8, 40, r.randint(1, 500)]) for _ in range(r.randint(0, 120))] + [r.randint(1, 4000)] * r.randint(0, 2)
        got = sharding.schedule(list(collections.Counter(sizes).items()), shards)
        spelled = {}
        for size, runs in got.items():
            assert [a for a, _, _ in runs] == [0, *(z for _, z, _ in runs[:-1])]
            spelled[size] = [turn[k % len(turn)] for a, z, turn in runs for k in range(z - a)]
        assert spelled == plain_schedule(sizes, shards)[1]


def test_a_hot_group_leaves_few_runs():
    got = sharding.schedule([(10**9, 1), *((s, 50_000) for s in range(1, 200))], 24)
    assert sum(len(runs) for runs in got.values()) < 200 * 24


def test_shards_have_the_loads_of_the_plain_schedule(spark, monkeypatch):
    r = random.Random(6)
    texts = ["z" * r.randint(0, 90) + str(r.randrange(500)) for _ in range(2000)] + ["copy"] * 1000 + [None] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = collections.Counter(texts)
    for bucket in (sharding.BUCKET_ROWS, 100):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
        rows = sharding.shard_documents(df, 7).collect()
        assert len(rows) == len(texts)
        load = check_shards(rows, dict(enumerate(texts)), 7)
        assert [load[s] for s in range(7)] == plain_schedule([(len(t or "") + 8) * n for t, n in groups.items()], 7)[0]
