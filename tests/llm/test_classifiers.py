import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cohortlens.llm import fitting, quality, toxicity
from cohortlens.llm.common import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def marked(spark):
    docs, labels = read_table(spark, SF, "documents").select("doc_id", "text"), read_table(spark, SF, "labels")
    return docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4


def test_logistic_and_lbfgs_agree():
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=(300, 3)), np.ones(300)])
    y = (x @ [1.0, -2.0, 0.5, 0.3] + r.logistic(size=300) > 0).astype(float)
    penalty = np.array([0.01, 0.01, 0.01, 1e-9])

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w), x.T @ (fitting.sigmoid(z) - y) + penalty * w

    assert np.allclose(fitting.logistic(x, y), fitting.lbfgs(loss, np.zeros(4)), atol=1e-2)


def test_ordinal_gradient_by_differences():
    rows = [{"at": [0, 2], "n": [1, 2], "words": 9, "y": 1}, {"at": [1], "n": [3], "words": 20, "y": 0}, {"at": [], "n": [], "words": 4, "y": 0},
            {"at": [0, 1, 2], "n": [2, 1, 3], "words": 30, "y": 1}, {"at": [2], "n": [5], "words": 11, "y": 1}]
    model = toxicity._ordinal(rows, 3)
    assert (np.diff(model["cuts"]) > 0).all() and len(model["weights"]) == 3


def test_toxicity_on_held_out_labels(marked):
    docs, labels, remainder = marked
    model = toxicity.fit(docs, labels.filter(remainder != 2))
    assert (np.diff(model["cuts"]) > 0).all()
    rows = toxicity.score(docs, model).join(labels.filter(remainder == 2), "doc_id").collect()
    bad = [r["p_toxic"] >= 0.5 for r in rows if r["toxic"] == 1]
    good = [r["p_toxic"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert np.mean(bad) > 0.55 and np.mean(good) < 0.05
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["grade"] <= toxicity.GRADES for r in rows)
    assert all(r["severity"] >= r["p_toxic"] for r in rows)


def test_quality_on_held_out_labels(marked):
    docs, labels, remainder = marked
    rows = quality.score(docs, quality.fit(docs, labels.filter(remainder != 2))).join(labels.filter(remainder == 2), "doc_id").collect()
    right = [(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]
    assert np.mean(right) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_scores_against_plain_compression(marked):
    """Every score is the logistic of one number: the difference of the two compressed sizes over their sum."""
    docs, labels, _ = marked
    model = quality.fit(docs, labels)
    assert model["weights"].shape == (2,) and model["mean"].shape == (1,)
    sides = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind)) for data, kind in model["dictionaries"]]
    rows = quality.score(docs.withColumn("copy", F.col("text")), model).collect()
    for r in rows[:400]:
        good, bad = (len(c.compress((r["copy"] or "").encode())) for c in sides)
        z = ((bad - good) / (bad + good) - model["mean"][0]) / model["sd"][0]
        assert abs(r["score"] - 1 / (1 + np.exp(-(np.clip(z, -8, 8) * model["weights"][0] + model["weights"][1])))) < 1e-9


def test_dictionary_of_few_samples_holds_whole_samples(monkeypatch):
    monkeypatch.setattr(quality, "DICTIONARY_BYTES", 300)
    data, _ = quality._dictionary([b"a" * 250, b"b" * 200, b"c" * 20])
    assert data == b"a" * 250 + b"\n" + b"c" * 20


def test_dictionaries_learn_from_whole_texts(spark, monkeypatch):
    """The marks of quality stand after 4,000 characters only; every chunk is taught, or, above the bound, some of every depth."""
    def text(i):
        return f"{i} " + "same words for both sides " * 200 + (" excellent prose" if i % 2 else " dreadful noise") * 600

    docs = spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen, train = [], quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda samples: (seen.append(samples), train(samples))[1])
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows)
    good, bad = (b"".join(s).decode() for s in seen)
    for side in (good, bad):
        ids = [int(i) for i in re.findall(r"(\d+) same words", side)]
        assert ids and side == "".join(map(text, ids))
    assert max(len(t) for s in seen for t in s) <= 4000
    monkeypatch.setattr(quality, "DICTIONARY_CHUNKS", 12)
    seen.clear()
    quality.fit(docs, labels)
    assert [len(s) for s in seen] == [12, 12] and any(b"excellent" in t for t in seen[0]) and any(b"same words" in t for t in seen[0])


def test_fits_do_not_depend_on_row_order(marked):
    docs, labels, remainder = marked
    some = labels.filter(remainder == 1)
    for fit in (toxicity.fit, quality.fit):
        a, b = fit(docs, some), fit(docs.repartition(7), some.repartition(5))
        assert np.allclose(a["weights"], b["weights"])


def test_awkward_rows_and_missing_labels(spark, awkward, empty):
    clash = awkward.withColumn("score", F.lit("x")).withColumn("grade", F.lit("y")).withColumn("severity", F.lit(1))
    schema = "doc_id long, toxic int, quality int"
    sides = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (3, None, None), (7, 5, 7)], schema)  # teaches nothing
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, 0, 1), (10, 0, 1)], schema)
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 21)], schema)
    for labels in (none, sides, one, both):
        for docs in (clash, empty):
            t = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
            q = quality.score(docs, quality.fit(docs, labels)).collect()
            assert len(t) == len(q) == docs.count()
            assert all(np.isfinite(r["severity"]) and np.isfinite(r["p_toxic"]) for r in t) and all(0 <= r["score"] <= 1 for r in q)
    kept = toxicity.remove_toxic(clash, toxicity.fit(clash, none))
    assert kept.columns == clash.columns and kept.count() == clash.count() and {r["grade"] for r in kept.collect()} == {"y"}
    assert {r["score"] for r in quality.score(awkward, quality.fit(awkward, one)).collect()} == {1.0}
    assert {r["score"] for r in quality.score(awkward, quality.fit(awkward, none)).collect()} == {0.5}
