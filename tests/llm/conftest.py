"""Small tables with the awkward cases that every operator must stand."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n))


def awkward_rows():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(2, 40)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "ONE two"),
        (10, words(3, 30) + " " + passage + " " + words(4, 30)), (11, words(5, 25) + " " + passage), (12, "ab" * 400), (13, "x" * 30_000),
        (14, "é" * 80 + " ünïcode 𝔘𝔫𝔦 " + "é" * 70), (15, words(6, 5000)), (16, words(7, 9)), (17, "don't we'll 'tis  it's\n\n 12３٣ x y　z !?"),
        (18, "\x00\x01 control \x1f chars"), (19, "_" * 60 + "!!" * 40), (None, words(8, 20)), (None, base), (20, base.upper()),
    ]
    rows += [(1, base)]  # a repeated row
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def as_bytes(text):
    return (text or "").encode()
