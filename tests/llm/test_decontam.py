import random
import re
import tracemalloc

from pyspark.sql import functions as F

from cohortlens.llm import decontam


def brute(text, items, window):
    find = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    words, hit, ids = find(text), set(), set()
    for item, body in items:
        own = find(body)
        m = min(window, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            for at in range(len(words) - m + 1):
                if words[at:at + m] == own[k:k + m]:
                    hit.update(range(at, at + m))
                    ids.add(item)
    return len(words), len(hit), sorted(i for i in ids if i is not None)


def test_search_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        vocabulary = [b"a", b"b", b"cc", b"d1"]
        windows = {tuple(r.choice(vocabulary) for _ in range(m)) for m in [r.randint(1, 4)] * r.randint(1, 4)}
        m = len(next(iter(windows)))
        search = decontam.WuManber(m, {w: {i} for i, w in enumerate(windows)})
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        found = sorted((at, tuple(words[at:at + m])) for at, _ in search.search(words))
        assert found == sorted((at, tuple(words[at:at + m])) for at in range(len(words) - m + 1) if tuple(words[at:at + m]) in windows)


def items_of(spark, awkward):
    long = awkward.filter("doc_id = 10").first()["text"].split()
    rows = [(1, " ".join(long[5:25])), (2, "one TWO"), (3, None), (4, " .. "), (None, "ünïcode"), (5, "one TWO"), (5, "control"), (6, "nothing of the kind")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_awkward_rows_in_one_pass_and_in_many(spark, awkward):
    items, rows = items_of(spark, awkward)
    clash = awkward.withColumn("n_hit", F.lit("x")).withColumn("item_ids", F.lit(1)).withColumn("copy", F.col("text"))
    for block_bytes in (decontam.BLOCK_BYTES, 20):
        out = decontam.contamination(clash, items, block_bytes=block_bytes).collect()
        assert len(out) == awkward.count()
        for r in out:
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == brute(r["copy"], rows, 10)
            assert sum(s["last"] - s["first"] + 1 for s in r["hit_spans"]) == r["n_hit"]


def test_empty_tables_and_removal(spark, awkward, empty):
    items, rows = items_of(spark, awkward)
    none = items.limit(0)
    assert decontam.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(awkward, none).collect()} == {0}
    clash = awkward.withColumn("n_hit", F.lit("x"))
    kept = decontam.remove_contaminated(clash, items)
    assert kept.columns == clash.columns
    expected = sorted(str(r["text"]) for r in awkward.collect() if brute(r["text"], rows, 10)[1] == 0)
    assert sorted(str(r["text"]) for r in kept.collect()) == expected
    assert {r["n_hit"] for r in kept.collect()} == {"x"}


def test_items_with_text_ids_are_listed(spark, awkward):
    items = spark.createDataFrame([("b-2", "one two"), ("a-1", "ONE two"), (None, "two")], "item_id string, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.contamination(awkward, items).collect()}
    assert got[7] == got[9] == ["a-1", "b-2"] and got[5] == []


def test_tables_stay_small():
    """Items of 100 words from 50,000: building and keeping the tables of a block takes less than 15 times its text."""
    r = random.Random(11)
    rows = [(i, " ".join(f"word{r.randrange(50_000)}" for _ in range(100)).encode()) for i in range(2_000)]
    size = sum(len(text) for _, text in rows)
    tracemalloc.start()
    searches = decontam.Searches(rows, 10)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size > 1 << 20 and peak < 15 * size
    n_words, n_hit, spans, items = searches.search([rows[3][1], None, b"word1 " * 30, rows[7][1][:400]], [(None, None)] * 4)
    assert n_words[:3] == [100, 0, 30] and n_hit[:3] == [100, 0, 0] and items[:3] == [{3}, set(), set()] and items[3] == {7}
    assert spans[0] == [{"first": 0, "last": 99}] and spans[1] == []


def test_blocks_are_bounded_by_their_tables(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(60)], "item_id long, text string")
    bound = 20_000
    blocks = list(decontam.benchmark_blocks(items, "item_id", "text", bound))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(60))
    for b in blocks:
        words = [w for _, t in b for w in decontam.words_of(t)]
        assert len(words) * decontam.WORD_BYTES + len(set(words)) * decontam.NEW_WORD_BYTES <= bound
