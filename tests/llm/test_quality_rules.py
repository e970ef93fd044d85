import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.llm import quality_rules as rules
from cohortlens.llm.common import read_table
from tests.llm.conftest import awkward_rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, repeated, len(words) < 20 or 100 * repeated > 30 * len(words))


def texts(seed, n=300):
    r = random.Random(seed)
    pool = ["a", "b", "c", "dé", "**x**", "|", "<p>", "日本", "100%"]
    return [r.choice([" ", "\n", "  ", "\t"]).join(r.choices(pool[:r.randrange(1, 9)], k=r.randrange(0, 90))) + r.choice(["", "\n", "\nsame line\nsame line", "\n \n \n"]) for _ in range(n)]


def check(rows):
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected(r["body"])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= rules.KEEP) and 0 <= r["p_good"] <= 1


def test_counts_by_force(spark):
    bodies = texts(5) + ["w " * 40_000, "x" * 300_000, "é" * 140_000] + [t for _, t, *_ in awkward_rows()]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(bodies)], "doc_id long, text string, body string").repartition(4)
    none = spark.createDataFrame([], "doc_id long, quality int")
    check(rules.judge(df, rules.fit(df, none)).collect())


def test_hashed_values_by_pieces(monkeypatch):
    """A long text hashed in pieces has the values that it has as a whole."""
    text = " ".join(texts(6, 20)).encode()
    hashed = rules.Reader().words(text)[1]
    whole = rules.features(text, hashed)
    assert np.isclose((whole ** 2).sum(), 2.0)
    for piece in (1, 5, 64, len(text.decode()) - 3, len(text.decode()) - 2):
        monkeypatch.setattr(rules, "PIECE", piece)
        assert np.array_equal(rules.features(text, hashed), whole)
    points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    counted = sum(np.bincount([int(rules._windows(points[i:i + w], w)[0]) >> 51 for i in range(len(points) - w + 1)], minlength=rules.BUCKETS) for w in (3, 4))
    assert np.allclose(whole[rules.BUCKETS:], np.sqrt(counted / counted.sum()))


def test_held_out_labels(spark):
    docs, labels = read_table(spark, SF, "documents").select("doc_id", "text"), read_table(spark, SF, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    judged = rules.judge(docs.withColumn("body", F.col("text")), rules.fit(docs, labels.filter(remainder != 2)))
    rows = judged.join(labels.filter(remainder == 2), "doc_id").collect()
    check(rows)
    good, bad = ([r for r in rows if r["quality"] == side] for side in (1, 0))
    assert np.mean([r["p_good"] >= rules.KEEP for r in good]) > 0.9
    assert np.mean([r["p_good"] < rules.KEEP for r in bad]) > 0.9
    # calibrated: the mean chance is near the share of label 1
    assert abs(np.mean([r["p_good"] for r in rows]) - len(good) / len(rows)) < 0.1


def test_awkward_rows_and_missing_labels(spark, awkward, empty):
    clash = awkward.withColumn("body", F.col("text")).withColumn("kept", F.lit("x")).withColumn("margin", F.lit(1)).withColumn("y", F.lit(2))
    schema = "doc_id long, quality int"
    none, sides = spark.createDataFrame([], schema), spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None), (7, 5)], schema)
    one, both = spark.createDataFrame([(1, 0), (10, 0)], schema), spark.createDataFrame([(i, i % 2) for i in range(1, 21)], schema)
    for labels in (none, sides, one, both):
        rows = rules.judge(clash, rules.fit(clash, labels)).collect()
        assert len(rows) == clash.count()
        check(rows)
        assert rules.judge(empty, rules.fit(empty, labels)).count() == 0
    assert {r["p_good"] for r in rules.judge(clash, rules.fit(clash, one)).collect()} == {0.0}
    assert {r["p_good"] for r in rules.judge(clash, rules.fit(clash, none)).collect()} == {1.0}


def test_vectors_hold_one_dense_text_at_a_time():
    """A batch of many short texts takes the room of its sparse vectors, not a dense row of 2 * BUCKETS values a text (some 130 MB here)."""
    bodies = [" ".join(t.split()[:30]).encode() for t in texts(7, 1000)] + [b""]
    batch = pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array([1.0] * len(bodies))], ["__body", "label"])
    list(rules.vector_batches([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        made = list(rules.vector_batches([batch]))
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
    vectors = [v for b in made for v in b.column(1).to_pylist()]
    assert len(vectors) == len(bodies)
    for body, v in zip(bodies, vectors):
        assert (v["type"], v["size"]) == (0, 2 * rules.BUCKETS)
        dense = np.zeros(2 * rules.BUCKETS)
        dense[v["indices"]] = v["values"]
        assert np.array_equal(dense, rules.features(body, rules.Reader().words(body)[1]))


def test_fit_has_one_python_step_a_text(spark, monkeypatch):
    """What the fit writes comes from one Arrow map; no second Python step takes the vectors' values row by row."""
    plans, write = [], rules.shared_table

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(rules, "shared_table", seen)
    bodies = texts(8, 80)
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("**x**" in t)) for i, t in enumerate(bodies)], "doc_id long, quality int")
    model = rules.fit(docs, labels)
    assert model["weights"] is not None and len(model["weights"]) == 2 * rules.BUCKETS and np.any(model["weights"])
    assert plans and sum("MapInArrow" in p for p in plans) == 1
    assert not any("EvalPython" in p for p in plans)
