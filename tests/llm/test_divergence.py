import random
import re
from collections import Counter

import pytest

from cohortlens.llm import divergence

DOC = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def expected(rows, least, best=50):
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in of for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for d in of if d[1] == s for t in d[2]) for s in {d[1] for d in of}}

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = p(Counter(t for d in of for t in d[2]))
        each = {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((whole[t] - each[s][t], t.encode(), t) for t in kept if counts[s][t] and each[s][t] > whole[t])[:best]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def random_docs(seed, n=400):
    r = random.Random(seed)
    words = ["a", "ab", "abc", "b", "Éa", "éa", "zz", "don't", "x1y", "Straße", "日本", "𝔘x", "Upper", "upper", "q"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    return [(i, r.choice([None, ""]) if i % 17 == 0 else " ".join(r.choices(words, k=r.randrange(1, 40))), r.choice(["en", "en", "en", "de", None, "tiny"] if i else ["rare"]),
             r.choice([f"s{k}" for k in range(7)] + [None, "é"])) for i in range(n)]


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_transducer_gives_ordinals_and_is_minimal():
    r = random.Random(1)
    terms = sorted({bytes(r.choice(b"ab\xc3\xff") for _ in range(r.randrange(1, 8))) for _ in range(700)})
    builder = divergence.Builder()
    for t in terms:
        builder.add(t)
    made = builder.arrays()
    found = divergence.Transducer(made["keys"], made["next"], made["out"], made["ends"], made["root"])
    others = [b"", b"a" * 500, *(bytes(r.choice(b"ab\xc3\xff") for _ in range(r.randrange(0, 9))) for _ in range(500))]
    at = {t: i for i, t in enumerate(terms)}
    assert found.ordinals(terms).tolist() == list(range(len(terms)))
    assert found.ordinals(others).tolist() == [at.get(t, -1) for t in others]
    # no two states accept the same tails
    tails = {}

    def accepted(state):
        own = ({b""} if builder.ends[state] else set()) | {bytes([b]) + t for b, s in builder.edges[state] for t in accepted(s)}
        return frozenset(own)

    for state in range(len(builder.edges)):
        assert tails.setdefault(accepted(state), state) == state


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "round_bytes": 300, "terms": 4, "sources": 2}, {"block": 1, "terms": 1, "sources": 1}])
def test_audit_by_force(spark, sizes):
    rows = random_docs(2)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    assert result(divergence.audit(df, least=30, **sizes)) == expected(rows, 30)
    if not sizes:
        assert result(divergence.audit(df, least=3, best=7)) == expected(rows, 3, 7)


def test_chance_is_exact(spark):
    cases = [(0, 0, 1), (3, 7, 2), (10 ** 12, 10 ** 12, 10 ** 6), (123456789012, 999999999999, 7), (5, 10 ** 13, 10 ** 8)]
    df = spark.createDataFrame(cases, "n long, total long, terms long").select(divergence.chance("n", "total", "terms").alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10 ** 9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


def test_awkward_and_empty(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    for least in (1, 30):
        assert result(divergence.audit(awkward.withColumn("term", awkward["text"]).withColumn("n", awkward["doc_id"]), least)) == expected(rows, least)
    assert divergence.audit(empty).count() == 0


def test_terms_of_every_pair_of_bytes():
    text = b"".join(bytes([65 + a % 26, a, b]) for a in range(256) for b in range(256))
    lower = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
    assert divergence.terms_of(text) == re.findall(rb"[a-z\x80-\xff]+", text.translate(lower))
    assert divergence.terms_of(b"") == divergence.terms_of(None) == [] and len(divergence._LOWER) == 256
