"""How far the sources of a language differ in their words: a vocabulary held in minimal acyclic transducers.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased.  A language keeps the terms that stand in at least ``least`` of its documents.
A group (language, source) or a language as a whole gives a kept term, counted c times among N kept ones, p = 1 + floor(10**9 (c + 5) / (N + 5 V)).

1. Documents per (language, term): counted inside tasks first.
2. Kept terms are numbered in UTF-8 order by a distributed prefix sum and cut into blocks of ``BLOCK`` terms.  From each block's sorted terms a task builds
   the minimal acyclic transducer: equal tails share states, and the numbers on the path to a term add up to its ordinal.
3. Whole texts stream through the transducers, which count again, kept terms only.  They are broadcast in rounds of at most ``ROUND_BYTES``, whatever the
   vocabulary's size; a text is read once a round (one round to about four million terms).  Counts leave a task pre-aggregated.
4. Pairs of sources are compared in cells: ``TERMS`` ordinals and two blocks of ``SOURCES`` sources, as a dense matrix.  A pair's row is the sum over cells.
   Best terms are ranked by value and ordinal; only then are their names looked up.

All numbers are whole and exact: the quotient is taken in three steps of 1,000.

Defined cases: null text, language and source are empty; a language that keeps no term has pairs of value 0 and no terms; other columns are not used.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ordering import global_row_number

from .common import shared_table, small_batches, text_slices, tidy, tidy_group

BLOCK = 100_000
ROUND_BYTES = 64 << 20
TERMS = 4096
SOURCES = 128
HELD = 400_000      # terms with their counts that a task holds
SUMMED = 2_000_000  # ordinals with their counts, as arrays
SLICE_BYTES = 2 << 20
SCALE_STEPS, STEP = 3, 1000  # 10**9 in steps whose products stay within 64 bits
# A-Z lower-cased, what stands in no term a space: no other byte of a term is white space to ``bytes.split``
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


class Builder:
    """Minimal acyclic transducer from sorted distinct strings: the tail that the next string cannot share is merged into known states."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.edges: list[tuple] = []  # of a finished state: ((byte, state), ...)
        self.ends: list[int] = []     # whether a string ends there
        self.paths: list[int] = []    # strings from there on
        self.open: list[list] = [[0, []]]  # states along the last string: [ends here, finished edges]
        self.last = b""

    def add(self, term: bytes) -> None:
        shared = 0
        for a, b in zip(term, self.last):
            if a != b:
                break
            shared += 1
        self._finish(shared)
        self.open += [[0, []] for _ in range(len(term) - shared)]
        self.open[-1][0] = 1
        self.last = term

    def _state(self, ends: int, edges: list) -> int:
        key = (ends, *edges)
        if key not in self.known:
            self.known[key] = len(self.edges)
            self.edges.append(tuple(edges))
            self.ends.append(ends)
            self.paths.append(ends + sum(self.paths[s] for _, s in edges))
        return self.known[key]

    def _finish(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            state = self._state(*self.open.pop())
            self.open[-1][1].append((self.last[len(self.open) - 1], state))

    def arrays(self) -> dict:
        """(state, byte) keys in order, with next states and outputs; the root's number; which states end a string."""
        self._finish(0)
        root = self._state(*self.open[0])
        keys, following, output = [], [], []
        for state, edges in enumerate(self.edges):
            passed = self.ends[state]
            for byte, target in edges:  # in order of bytes, as the strings came
                keys.append(state << 8 | byte)
                following.append(target)
                output.append(passed)
                passed += self.paths[target]
        return {"keys": np.array(keys, "<i8"), "next": np.array(following, "<i4"), "out": np.array(output, "<i4"), "ends": np.array(self.ends, "u1"), "root": root}


class Transducer:
    def __init__(self, keys, following, output, ends, root):
        self.keys, self.next, self.out, self.ends, self.root = keys, following, output, ends, root

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Each string's ordinal in the block, -1 for strings that it does not hold; all strings advance a byte at a time."""
        found = np.full(len(terms), -1, np.int64)
        if not len(terms) or not len(self.keys):
            return found
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        raw = np.frombuffer(b"".join(terms), np.uint8)
        begin = np.cumsum(sizes) - sizes
        alive, state, total = np.arange(len(terms)), np.full(len(terms), self.root, np.int64), np.zeros(len(terms), np.int64)
        step = 0
        while len(alive):
            over = sizes[alive] == step
            ended = over & (self.ends[state] == 1)
            found[alive[ended]] = total[ended]
            alive, state, total = alive[~over], state[~over], total[~over]
            key = state << 8 | raw[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state, total = self.next[at].astype(np.int64), total[ok] + self.out[at]
            step += 1
        return found


def _text(value) -> str:
    return value or ""


def _documents_with(batches):
    """(lang, term, n): the task's documents with each term."""
    seen: dict[str, Counter] = {}
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def flush():
        for lang, counts in seen.items():
            names = list(counts)
            for k in range(0, len(names), 50_000):
                part = names[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                                                  pa.array([counts[t] for t in part], pa.int64())], schema=schema)
        seen.clear()

    for whole in batches:
        for batch in text_slices(whole, 1, SLICE_BYTES):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, seen.values())) > HELD:
                yield from flush()
    yield from flush()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, ordinal, term) of ``docs`` (lang, text as bytes): ordinals from 0 in UTF-8 order, per language."""
    counted = docs.select("lang", "text").mapInArrow(tidy(_documents_with), "lang string, term binary, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")
    numbered = global_row_number(kept, ["term"], ["lang"], name="place")
    return shared_table(numbered.select("lang", (F.col("place") - 1).alias("ordinal"), "term"), "kept-terms")


BUILT = "lang string, block long, first binary, last binary, size long, keys binary, next binary, out binary, ends binary, root long"


def _build(table: pa.Table) -> pa.Table:
    terms = sorted(table.column("term").to_pylist())
    builder = Builder()
    for term in terms:
        builder.add(term)
    made = builder.arrays()
    raw = {k: v.tobytes() for k, v in made.items() if k != "root"}
    row = {"lang": table.column("lang")[0].as_py(), "block": table.column("block")[0].as_py(), "first": terms[0], "last": terms[-1],
           "size": sum(map(len, raw.values())), **raw, "root": made["root"]}
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist([row], pa.schema([(n, types[t]) for n, t in (f.strip().split(" ") for f in BUILT.split(","))]))


def transducers(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block of a language's terms: the transducer's arrays, the first and last term and the first ordinal (``block``)."""
    blocks = kept.withColumn("block", F.expr(f"ordinal div {block} * {block}"))
    return shared_table(blocks.groupBy("lang", "block").applyInArrow(tidy_group(_build), BUILT), "transducers")


class Vocabulary:
    """The transducers of one round, by language."""

    def __init__(self, rows):
        self.of: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["lang"], r["block"])):
            made = Transducer(np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["next"], "<i4"), np.frombuffer(r["out"], "<i4"), np.frombuffer(r["ends"], "u1"), r["root"])
            self.of.setdefault(r["lang"], []).append((bytes(r["first"]), bytes(r["last"]), r["block"], made))

    def look_up(self, lang: str, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, counts) of the kept terms among the counted ones."""
        terms = sorted(counts)
        ordinals = []
        for first, last, base, made in self.of[lang]:
            part = terms[bisect.bisect_left(terms, first):bisect.bisect_right(terms, last)]
            at = made.ordinals(part)
            ordinals += [(base + o, counts[t]) for o, t in zip(at[at >= 0].tolist(), [part[i] for i in np.flatnonzero(at >= 0).tolist()])]
        pairs = np.array(ordinals, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _recount(shared):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        counts: dict[tuple, Counter] = {}  # terms not looked up yet
        sums: dict[tuple, list] = {}       # ordinals and counts

        def look_up():
            for key, of_group in counts.items():
                found = vocabulary.look_up(key[0], of_group)
                if len(found[0]):
                    sums.setdefault(key, []).append(found)
            counts.clear()

        def summed(parts):
            o, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            each, at = np.unique(o, return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, at, n)
            return each, total

        def flush():
            for (lang, source), parts in sums.items():
                o, n = summed(parts)
                for k in range(0, len(o), 50_000):
                    m = len(o[k:k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(o[k:k + 50_000]),
                                                      pa.array(n[k:k + 50_000])], schema=schema)
            sums.clear()

        for whole in batches:
            for batch in text_slices(whole, 2, SLICE_BYTES):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if lang in vocabulary.of:
                        counts.setdefault((lang, source), Counter()).update(terms_of(text))
                if sum(map(len, counts.values())) > HELD // 2:
                    look_up()
                    if sum(len(p[0]) for parts in sums.values() for p in parts) > SUMMED:
                        yield from flush()
        look_up()
        yield from flush()
    return run


def recount(docs: DataFrame, built: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, ordinal, n) of ``docs`` (lang, source, text as bytes): every occurrence of every kept term."""
    spark = docs.sparkSession
    sizes = [(r["lang"], r["block"], r["size"]) for r in built.select("lang", "block", "size").orderBy("lang", "block").collect()]  # one row a block
    rounds, full = [[]], 0
    for lang, block, size in sizes:
        if rounds[-1] and full + size > round_bytes:
            rounds.append([])
            full = 0
        rounds[-1].append((lang, block))
        full += size
    counted = None
    for part in rounds:
        wanted = spark.createDataFrame(part, "lang string, block long")
        shared = spark.sparkContext.broadcast([r.asDict() for r in built.join(F.broadcast(wanted), ["lang", "block"]).collect()])  # at most round_bytes, or one block
        found = docs.select("lang", "source", "text").mapInArrow(tidy(_recount(shared)), "lang string, source string, ordinal long, n long")
        found = shared_table(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "term-counts")
        shared.destroy()
        counted = found if counted is None else counted.union(found)
    return counted


def chance(count, total, terms):
    """1 + floor(10**9 (count + 5) / (total + 5 terms)) of whole columns, without leaving 64 bits."""
    share, rest = f"({count} + 5) div ({total} + 5 * {terms})", f"({count} + 5) % ({total} + 5 * {terms})"
    for _ in range(SCALE_STEPS):
        share, rest = f"(({share}) * {STEP} + (({rest}) * {STEP}) div ({total} + 5 * {terms}))", f"((({rest}) * {STEP}) % ({total} + 5 * {terms}))"
    return F.expr(f"1 + {share}")


def _cell(table: pa.Table) -> pa.Table:
    """Summed differences of the pairs of sources of one cell; (a, b) once, a the smaller number."""
    rows = {c: table.column(c).to_numpy() for c in ("source_no", "own", "ordinal", "p", "p0", "width", "i", "j", "part")}
    lang, i, j = table.column("lang")[0].as_py(), rows["i"][0], rows["j"][0]
    base, width = rows["part"][0], int(rows["width"][0])
    sources, first = np.unique(rows["source_no"], return_index=True)
    p = np.repeat(rows["p0"][first][:, None], width, axis=1)
    real = rows["ordinal"] >= 0
    p[np.searchsorted(sources, rows["source_no"][real]), rows["ordinal"][real] - base] = rows["p"][real]
    own = rows["own"][first]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = {"lang": [], "a": [], "b": [], "value": []}
    for k in left.tolist():
        others = right[right > k] if i == j else right
        if len(others):
            out["a"] += [int(sources[k])] * len(others)
            out["b"] += sources[others].tolist()
            out["value"] += np.abs(p[others] - p[k]).sum(axis=1).tolist()
    out["lang"] = [lang] * len(out["a"])
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())]))


def _pairs(counted: DataFrame, groups: DataFrame, terms: int, sources: int) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    # every source once in every range of terms, with what a term that it lacks gets; then the terms that it has
    ranges = groups.withColumn("part", F.explode(F.expr(f"sequence(0L, greatest(0L, terms - 1), {terms}L)")))
    width = F.least(F.lit(terms), F.col("terms") - F.col("part")).cast("int").alias("width")
    marks = ranges.select("lang", "source_no", "part", F.lit(-1).cast("long").alias("ordinal"), F.col("p0").alias("p"), "p0", width, "last")
    real = (counted.join(groups, ["lang", "source"]).withColumn("part", F.expr(f"ordinal div {terms} * {terms}"))
            .select("lang", "source_no", "part", "ordinal", chance("n", "total", "terms").alias("p"), "p0", width, "last"))
    placed = (marks.union(real).withColumn("own", F.expr(f"source_no div {sources}")).withColumn("other", F.explode(F.expr(f"sequence(0L, last div {sources})")))
              .select("lang", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "source_no", "ordinal", "p", "p0", "width"))
    cells = placed.groupBy("lang", "part", "i", "j").applyInArrow(tidy_group(_cell), "lang string, a long, b long, value long")
    summed = cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                                            F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("t")).select("lang", "value", "t.*")
    names = groups.select("lang", "source_no", "source")
    return (both.join(names.withColumnsRenamed({"source_no": "x"}), ["lang", "x"])
            .join(names.withColumnsRenamed({"source_no": "y", "source": "item"}), ["lang", "y"]).select("lang", "source", "item", "value"))


def audit(documents: DataFrame, least: int = 30, best: int = 50, block: int = BLOCK, round_bytes: int = ROUND_BYTES, terms: int = TERMS,
          sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a group with every other source of its language, part ``term`` has the terms
    that it uses more than its language does, the first ``best`` of them."""
    small_batches(documents.sparkSession)
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kept = kept_terms(docs, least)
    counted = recount(docs, transducers(kept, block), round_bytes)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
    # one row a (language, source): the result has a row for every pair of them
    groups = groups.withColumn("source_no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("last", F.max("source_no").over(Window.partitionBy("lang")))
    groups = shared_table(groups.withColumn("p0", F.when(F.col("terms") > 0, chance("0L", "total", "terms")).otherwise(0)), "term-groups")
    pairs = _pairs(counted, groups, terms, sources)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    whole = counted.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("terms").alias("all_terms"))
    p = (counted.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, ["lang", "ordinal"]).join(of_lang, "lang")
         .select("lang", "source", "ordinal", (chance("n", "total", "terms") - chance("all_n", "all_total", "all_terms")).alias("value")).filter("value > 0"))
    top = p.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).filter(F.col("rank") <= best)
    named = top.join(kept, ["lang", "ordinal"]).withColumn("item", F.col("term").cast("string"))

    def shaped(df, part):
        return df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))

    return shaped(pairs, "pair").union(shaped(named, "term"))
