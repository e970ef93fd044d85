"""Every registered query on the smallest tables, against its SQL where there is one."""

import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tools")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check import digest  # noqa: E402
from cohortlens.llm.queries import QUERIES, SQL  # noqa: E402
from cohortlens.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    answer = database.sql(SQL[name])
    columns, rows = answer.columns, answer.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, rows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_every_document(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name.startswith("op3_"):
        assert {i for r in rows for i in r["doc_ids"]} <= ids
    else:
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)


def test_pipeline_stages_keep_their_promise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    n = out.count()
    assert 0 < n < docs.count() and out.select("doc_id").distinct().count() == n
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_pipeline_stages_on_awkward_and_empty_documents(spark, awkward, empty):
    for docs in (awkward, empty, awkward.withColumn("keys", awkward["doc_id"]).withColumn("component", awkward["text"])):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert last.count() <= docs.count()
