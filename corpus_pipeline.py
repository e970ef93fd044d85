"""Cleaning and encoding of the document table, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``documents``; the
last returns token ids.  ``run`` writes each stage's rows to the shared folder and reads them again.

No SQL states the whole chain (the first stage is a fitted model); tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, decontam, ngram_join, suffix_dedup, toxicity
from cohortlens.llm.common import read_table, shared_table
from cohortlens.llm.queries import rank_file
from cohortlens.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxic grade is one half or more go.  The model learns from the labels of these documents."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.remove_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a Jaccard similarity of 0.8, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, k=5, share=(80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (a shorter item: with all of it) go."""
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian, two bytes an id), with digests of the decimal ids and of the bytes that decoding gives."""
    path = rank_file()
    done = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path, decimal="id_text")
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("id_text", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
