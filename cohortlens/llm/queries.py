"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

from . import (bpe, conversation_repair, decontam, divergence, maxscore, ngram_join, packing, quality, quality_rules, sharding, suffix_dedup, toxicity,
               urlfilter)
from .common import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


def rank_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query()
def op1_byte_bpe(spark, sf_dir):
    """Whole texts encoded, then decoded from the ids and checked by the piece offsets; digests of both, and the offsets."""
    path = rank_file()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path, offsets=True, slice_bytes=1 << 20), path, offsets="piece_offsets", decimal="id_text")
    return done.select("doc_id", "n_tokens", F.sha2("id_text", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), "piece_offsets")


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0) a),
lens AS (SELECT DISTINCT m FROM pats),
dwin AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, lens WHERE len(w) >= m) b),
hits AS (SELECT d.doc_id, d.m, d.s, p.item_id FROM dwin d JOIN pats p ON d.m = p.m AND d.win = p.win),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM hits) c GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) e GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


@query(OP8_SQL)
def op8_decontamination(spark, sf_dir):
    """Words of whole documents that lie inside occurrences of benchmark windows."""
    found = decontam.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
WHERE rank <= 10
"""


@query(OP10_SQL)
def op10_maxscore(spark, sf_dir):
    """The ten best partners of every hundredth vector."""
    return maxscore.top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


@query()
def op4_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes; equal texts share a shard."""
    done = sharding.shard_documents(read_table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_compression_quality(spark, sf_dir):
    """A quality score for every whole text; rows with remainder 2 teach nothing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = read_table(spark, sf_dir, "labels").filter(remainder != 2).select("doc_id", "quality")
    scored = quality.score(docs.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False))), quality.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op2_toxicity(spark, sf_dir):
    """Expected severity of every whole text; toxic from a chance of one half on."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query()
def op3_packing(spark, sf_dir):
    """All documents' ids packed into rows of 2,048; one result row per packed row."""
    path = rank_file()
    width = bpe.id_bytes(path)
    encoded = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, slice_bytes=2 << 20)
    rows = packing.rows_of(packing.pack(encoded, width, pad=bpe.vocabulary_size(path)), width)
    return rows.select("pack", "row", "doc_ids", "pieces", "cu_seqlens", F.element_at("cu_seqlens", -1).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


#: The rules that the query applies.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _op7_sql() -> str:
    steps = ["""
WITH u AS (
  SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
m AS (SELECT doc_id AS id, 1 - min(quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1)
      GROUP BY doc_id HAVING min(quality) = max(quality)),
t0 AS (SELECT page_id, host, path, rule, bad, '' AS template,
       CASE WHEN regexp_replace(path, '^/|/$', '', 'g') = '' THEN [] ELSE string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') END AS segs
       FROM r LEFT JOIN m ON m.id = r.page_id),
o AS (SELECT CASE WHEN count(bad) > 0 THEN 1.0 - CAST(sum(bad) AS DOUBLE) / count(bad) ELSE 1.0 END AS share FROM t0)"""]
    for k in (1, 2, 3):
        steps.append(f""",
k{k} AS (SELECT host, template, segs[{k}] AS seg, count(*) AS n, count(bad) AS marked, coalesce(sum(bad), 0) AS bad FROM t{k - 1}
        WHERE len(segs) >= {k} GROUP BY ALL),
p{k} AS (SELECT host, template, count(*) AS kinds, sum(n) AS nrows,
        (CAST(sum(bad) AS DOUBLE) + 1.0) / (CAST(sum(marked) AS DOUBLE) + 2.0) AS share FROM k{k} GROUP BY ALL
        HAVING NOT (count(*) >= 8 AND count(*) >= 0.5 * sum(n))),
d{k} AS (SELECT k.host, k.template, k.seg FROM k{k} k JOIN p{k} p ON k.host = p.host AND k.template = p.template
        WHERE abs(k.bad - p.share * k.marked) > 3.0 * sqrt(p.share * (1.0 - p.share) * k.marked)),
t{k} AS (SELECT t.page_id, t.host, t.path, t.rule, t.bad, t.segs,
        CASE WHEN len(t.segs) < {k} THEN t.template ELSE t.template || '/' || coalesce(d.seg, '*') END AS template
        FROM t{k - 1} t LEFT JOIN d{k} d ON len(t.segs) >= {k} AND d.host = t.host AND d.template = t.template AND d.seg = t.segs[{k}])""")
    steps.append(""",
f AS (SELECT * REPLACE (CASE WHEN len(segs) > 3 THEN template || '/**' ELSE template END AS template) FROM t3),
g AS (SELECT host, template, (count(bad) - coalesce(sum(bad), 0) + 10.0 * any_value(share)) / (count(bad) + 10.0) AS purity FROM f, o GROUP BY host, template)
SELECT page_id, f.host, path, rule,
  CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block'
       WHEN 'net/fr/' THEN 'block' ELSE CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
  f.template FROM f JOIN g ON g.host = f.host AND g.template = f.template""")
    return "".join(steps)


@query(_op7_sql())
def op7_url_filter(spark, sf_dir):
    """Every page's url judged by the rules, else by its host's path templates.  A page's label is the
    quality mark of its own id, the only labels the tables have."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    done = urlfilter.judge(read_table(spark, sf_dir, "pages"), URL_RULES, labels)
    return done.select("page_id", "host", "path", "rule", "verdict", "template")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0) a),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(s)) AS h FROM s GROUP BY doc_id),
same AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS rep FROM n),
reps AS (SELECT s.doc_id, s.s, r.n FROM s JOIN same r ON r.doc_id = s.doc_id AND r.rep = r.doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c
  FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (total - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM same WHERE rep = doc_id UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen),
m AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT w.doc_id, coalesce(same.n, 0) AS n_shingles, coalesce(m.component, w.doc_id) AS component_id
FROM w LEFT JOIN same ON same.doc_id = w.doc_id LEFT JOIN m ON m.node = same.rep
"""


@query(OP5_SQL)
def op5_ngram_join(spark, sf_dir):
    """Components of documents whose 4-word shingle sets reach a Jaccard similarity of 0.85."""
    return ngram_join.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, share=(85, 100))


@query()
def op6_suffix_dedup(spark, sf_dir):
    """Bytes of every whole text that 50-byte strings of earlier documents cover, removed."""
    done = suffix_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", (F.length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed",
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_quality_rules(spark, sf_dir):
    """Counted rules and the n-gram model's verdict on every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality")))


def _op12_sql() -> str:
    def best(options):
        return "list_sort([x FOR x IN [" + ", ".join(options) + "] IF x IS NOT NULL])[1]"

    # cost, audit and repaired rows from a row on, for each state; the least of cost and audit is the least tuple
    def then(cost, letter, row, rest):
        return (f"CASE WHEN {rest} IS NOT NULL THEN {{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, "
                f"'o': {f'list_prepend({row}, {rest}.o)' if row else f'{rest}.o'}}} END")

    stays, more = "r.fault IN (0, 3)", "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END"
    own = "r.role || ':' || r.text"

    def edits(state):  # of one row, without insertions before it
        follow = {"n": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[follow]
        keeps = {"n": (("s", "s"), ("u", "u")), "s": (("u", "u"),), "u": (("a", "a"),), "a": (("u", "u"),)}[state]
        out = [then("2", "D", None, f"b.{state}")]
        out += [f"CASE WHEN {stays} AND left(r.role, 1) = '{i}' THEN {then(more, 'K', own, f'b.{to}')} END" for i, to in keeps]
        out.append(f"CASE WHEN {stays} THEN {then(f'(1 + {more})', 'R', f"'{name}:' || r.text", f'b.{follow}')} END")
        return best(out)

    def inserted(state, table):  # up to two insertions before the row
        u, a = f"{table}.u", f"{table}.a"
        once = {"n": (u, "user"), "s": (u, "user"), "u": (a, "assistant"), "a": (u, "user")}[state]
        twice = a if once[0] == u else u
        second = "assistant" if once[1] == "user" else "user"
        return best([f"{table}.{state}", then("5", "I", f"'{once[1]}:'", once[0]),
                     then("10", "II", None, twice).replace("'o': " + f"{twice}.o", f"'o': list_concat(['{once[1]}:', '{second}:'], {twice}.o)")])

    states = "nsua"
    return r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS k
  FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), k), lambda c, x: xor(c >> 8, bits.t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
sizes AS (SELECT conv_id, max(pos) AS n FROM r GROUP BY conv_id),
""" + ("tail AS (SELECT conv_id, n + 1 AS pos, {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS n, {'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']} AS s, "
           "{'c': 5, 'a': 'I', 'o': ['assistant:']} AS u, {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS a FROM sizes), "
           "back AS (SELECT * FROM tail UNION ALL SELECT e.conv_id, e.pos, " + ", ".join(f"{inserted(q, 'e')} AS {q}" for q in states)
           + " FROM (SELECT b.conv_id, r.pos, " + ", ".join(f"{edits(q)} AS {q}" for q in states)
           + " FROM back b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1) e),") + """
told AS (SELECT conv_id, n.c AS cost, n.a AS audit, n.o AS o FROM back WHERE pos = 1),
steps AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM r),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM steps GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query(_op12_sql())
def op12_conversation_repair(spark, sf_dir):
    """Every conversation damaged by its rows' crc32, then repaired at least cost."""
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair(rows, conversation_repair.damage(rows))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS row FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, row, unnest(list_distinct(w)) AS term FROM d) a GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
c AS (SELECT o.lang, source, o.term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (
  SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(l.c, 0) + 5)) // (t.n + 5 * v.v) AS q
  FROM k JOIN v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) t ON t.lang = k.lang
  LEFT JOIN (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) l ON l.lang = k.lang AND l.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(s.f), 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source
             GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) u) r
WHERE part = 'pair' OR rank <= 50
"""


@query(OP13_SQL)
def op13_source_divergence(spark, sf_dir):
    """Differences between the sources of each language, and the terms that set a source apart."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))
