import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from cohortlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.Ranks(f.read())


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_same_ids_as_the_library_on_random_strings(ranks, library):
    r = random.Random(1)
    bits = ["'s", "'re", "'ll", "'", "s", " ", "  ", "\n", "\t", "a", "é", "1", "²", "٣", "!", "'v", "e", "\0", "𝔘", "​", "　", "l", "d ", "x" * 150, "ab" * 100]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for text, (ids, offsets) in zip(texts, ranks.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode_ordinary(text), text
        assert offsets.tolist() == sorted(set(offsets.tolist()))


def test_scan_equals_stepping_the_automaton():
    r = np.random.default_rng(2)
    classes = r.integers(0, 9, 5000).astype(np.uint8)
    state, expected = bpe.FRESH, []
    for c in classes:
        expected.append(state)
        state = bpe.NEXT[c, state]
    assert bpe.states_before(classes).tolist() == expected


def test_code_points_of_every_class(ranks, library):
    texts = [f"a{chr(c)}1{chr(c)}a {chr(c)}\n{chr(c)}!" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for text, (ids, _) in zip(texts, ranks.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode_ordinary(text), hex(ord(text[1]))


def test_awkward_rows_round_trip(awkward, library):
    clash = awkward.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(clash.withColumn("copy", F.col("text")), PATH, offsets=True), PATH)
    out = rows.withColumn("digest", F.sha2(bpe.id_text(F.col("ids"), bpe.id_bytes(PATH)), 256)).collect()
    assert len(out) == awkward.count()
    for r in out:
        text = r["copy"] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["digest"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r["decoded"]) == text.encode()
        assert (r["piece_offsets"][:1] or [0]) == [0] and all(o < max(1, len(text.encode())) for o in r["piece_offsets"])


def test_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_op1_keeps_offsets_and_decoding_checks_them(spark):
    from cohortlens.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        raw, at = docs[r["doc_id"]].encode(), r["piece_offsets"]
        pieces = [raw[a:b].decode() for a, b in zip(at, at[1:] + [len(raw)])]
        assert pieces == regex.findall(public_tokenizers.PATTERN, docs[r["doc_id"]])
    with open(PATH, "rb") as f:
        words = bpe.Words(f.read())
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "doc_id long, text string")
    rows = bpe.encode(df, PATH, offsets=True).collect()
    for r in rows:
        words.check(bytes(r["ids"]), np.array(r["piece_offsets"], np.int64))
    ids = bytes(rows[0]["ids"])
    for wrong in ([], [1, 3], [0, 1], [0, 3, 3], [0, 7, 3], [0, 3, 13], [0, 3, 99]):
        with pytest.raises(ValueError):
            words.check(ids, np.array(wrong, np.int64))
    with pytest.raises(Exception, match="piece offsets do not fit"):
        bad = bpe.encode(df, PATH, offsets=True).withColumn("piece_offsets", F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
        bpe.decode(bad, PATH, offsets="piece_offsets").collect()


def test_decimal_ids_beside_the_bytes(awkward):
    done = bpe.decode(bpe.encode(awkward.withColumn("decimal", F.lit(1)), PATH), PATH, decimal="decimal")
    nothing = done.withColumn("ids", F.lit(None).cast("binary")).drop("decoded", "decimal")
    for rows in (done, bpe.decode(nothing, PATH, decimal="decimal")):
        assert rows.count() == awkward.count()
        assert rows.where(~F.col("decimal").eqNullSafe(bpe.id_text(F.col("ids"), bpe.id_bytes(PATH)))).count() == 0


def test_short_pieces_are_looked_up_once(ranks, library):
    # lengths around the key's, the same bytes at other lengths, zero bytes and pieces at the very end
    texts = ["ab abc abcdefg abcdefgh abcdefghi", "\0\0 \0", "a", "", "ab" * 4, "abcdefg", " abcdef abcdef  abcdefg", "é éé ééé éééé"] * 3
    seen = []
    lookup = ranks.lookup
    ranks.lookup = lambda pieces: seen.extend(pieces) or lookup(pieces)
    try:
        for text, (ids, _) in zip(texts, ranks.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode_ordinary(text), text
    finally:
        ranks.lookup = lookup
    short = [p for p in seen if len(p) <= bpe.SHORT_PIECE]
    assert len(short) == len(set(short))
