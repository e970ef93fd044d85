"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words: A-Z lower-cased, maximal runs of digits, a-z and bytes from 0x80 on.  A
benchmark item gives every window of ``window`` consecutive words; an item of
fewer words is one window.  Windows of one length share a search: a shift table
over two-word blocks says how far the window's end may jump, a bucket chosen by the
window's last block and then by its first block lists test windows, and comparing
all words confirms.

Words of the benchmark have numbers, and the tables are sorted arrays over them: 32-bit word numbers once, a window as its
place in them, each distinct window once with its items.  A slice of documents is searched by many cursors side by side, one for
every ``STRIDE`` words; a cursor looks its block up, jumps by the shift, and stops where the next one began.

The benchmark is the stated pattern set.  It is read in blocks whose tables take about ``block_bytes``
at most (one item at least); each block is broadcast and searched in one pass over the
documents, and passes are chained, so that no block's size grows with the benchmark.

Defined cases: a null or wordless text has no words and no hits; items without words
match nothing; an item with a null id hits but is not listed; an id that occurs twice is
listed once; ids that are not whole numbers are listed as text; columns ``n_words``, ``n_hit``, ``hit_spans``, ``item_ids``
of the input are replaced.
"""

from __future__ import annotations

import pickle
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, sheltered, small_batches, text_slices, tidy, utf8

WINDOW = 10
BLOCK_BYTES = 192 << 20
WORD_BYTES, NEW_WORD_BYTES = 80, 220  # what a word of the benchmark, and one not seen before, add to a block's tables while they are built
SLICE_BYTES = 1 << 20
STRIDE = 64
ADDED = ("n_words", "n_hit", "hit_spans", "item_ids")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table; -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Tables:
    """Wu-Manber tables of the windows of exactly ``length`` words that start at ``starts`` of ``flat`` (word numbers below ``n_words``); ``owners``
    holds the item of each."""

    def __init__(self, length: int, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, n_words: int):
        self.length, self.flat, self.n_words = length, flat, n_words
        self.block = min(2, length)
        self.jump = length - self.block + 1
        # shift: of every block, the least distance to a window's end
        self.blocks = self._distinct(starts)
        self.shift = np.full(len(self.blocks), self.jump, np.int32)
        for end in range(self.block - 1, length):
            self.shift[np.searchsorted(self.blocks, self._keys(flat, starts + end))] = length - 1 - end  # later ends are nearer
        # buckets: distinct windows by last block, then by first block; each once, with its items
        order = np.arange(len(starts))
        for word in range(length - 1, -1, -1):
            order = order[np.argsort(flat[starts[order] + word], kind="stable")]
        order = order[np.argsort(self._bucket(flat, starts[order]), kind="stable")]
        starts = starts[order]
        new = np.ones(len(starts), bool)
        if len(starts) > 1:
            same = np.ones(len(starts) - 1, bool)
            for word in range(length):
                same &= flat[starts[1:] + word] == flat[starts[:-1] + word]
            new[1:] = ~same
        self.items, self.first_item = owners[order], np.append(np.flatnonzero(new), len(starts))
        self.windows = starts[new]
        self.buckets = self._bucket(flat, self.windows)

    def _keys(self, words, ends):
        """Number of the block that ends at each place; -1 with a word that the benchmark lacks."""
        last = words[ends].astype(np.int64)
        if self.block == 1:
            return last
        before = words[ends - 1].astype(np.int64)
        return np.where((last < 0) | (before < 0), -1, before * self.n_words + last)

    def _distinct(self, starts):
        """Sorted numbers of the blocks of all windows, from one window end after the other."""
        known = np.empty(0, np.int64)
        for end in range(self.block - 1, self.length):
            keys = np.unique(self._keys(self.flat, starts + end))
            known = np.union1d(known, keys[_find(known, keys) < 0])
        return known

    def _bucket(self, words, starts):
        """Number of (last block, first block); both are blocks of the benchmark."""
        last = _find(self.blocks, self._keys(words, starts + self.length - 1))
        first = _find(self.blocks, self._keys(words, starts + self.block - 1))
        return np.where(first < 0, -1, last * len(self.blocks) + first)

    def search(self, words: np.ndarray):
        """(positions, windows) of all occurrences."""
        n = len(words)
        end = np.arange(self.length - 1, n, STRIDE)
        stop = np.minimum(end + STRIDE, n)
        hits = []
        while len(end):
            at = _find(self.blocks, self._keys(words, end))
            step = np.where(at < 0, self.jump, self.shift[at]) if len(self.shift) else np.full(len(end), self.jump)
            hits.append(end[step == 0])
            end = end + np.maximum(step, 1)
            live = end < stop
            end, stop = end[live], stop[live]
        start = np.concatenate(hits or [np.empty(0, np.int64)]) - (self.length - 1)
        bucket = self._bucket(words, start)
        low, high = np.searchsorted(self.buckets, bucket), np.searchsorted(self.buckets, bucket, side="right")
        found, which = [], []
        while len(start):
            live = low < high
            start, low, high = start[live], low[live], high[live]
            same = np.ones(len(start), bool)
            for word in range(self.length):
                same[same] = words[start[same] + word] == self.flat[self.windows[low[same]] + word]
            found.append(start[same])
            which.append(low[same])
            start, low, high = start[~same], low[~same] + 1, high[~same]
        none = np.empty(0, np.int64)
        return np.concatenate(found or [none]), np.concatenate(which or [none])

    def items_of(self, window: int) -> np.ndarray:
        return self.items[self.first_item[window]:self.first_item[window + 1]]


class WuManber:
    """Search for windows of exactly ``length`` words, given as tuples of words with their items."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.numbers: dict[bytes, int] = {}
        flat = [self.numbers.setdefault(w, len(self.numbers)) for window in windows for w in window]
        self.each = list(windows.values())
        self.tables = Tables(length, np.array(flat, np.int32), np.arange(len(self.each)) * length, np.arange(len(self.each)), len(self.numbers))

    def search(self, words: list[bytes]):
        """Yields (first position, items) of every occurrence, in order."""
        at, which = self.tables.search(np.array([self.numbers.get(w, -1) for w in words], np.int32))
        for k in np.argsort(at, kind="stable"):
            yield int(at[k]), self.each[int(self.tables.items_of(which[k])[0])]


class Searches:
    """One block of the benchmark: tables for each window length."""

    def __init__(self, rows, window: int):
        self.numbers: dict[bytes, int] = {}
        self.ids = [item for item, _ in rows]
        flat, by_length = array("i"), {}
        for k, (_, text) in enumerate(rows):
            words = words_of(text)
            m = min(window, len(words))
            if m:
                starts, owners = by_length.setdefault(m, (array("q"), array("i")))
                starts.extend(range(len(flat), len(flat) + len(words) - m + 1))
                owners.extend([k] * (len(words) - m + 1))
                flat.extend(self.numbers.setdefault(w, len(self.numbers)) for w in words)
        flat = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)
        self.tables = [Tables(m, flat, np.frombuffer(starts, np.int64), np.frombuffer(owners, np.int32), len(self.numbers))
                       for m, (starts, owners) in sorted(by_length.items())]

    def search(self, texts: list[bytes | None], before):
        """Per text: number of words, number of covered words, merged [first, last] word spans that occurrences cover, set of items that occur.
        ``before`` holds spans and items that are known already."""
        get, lengths, words = self.numbers.get, [], array("i")
        for text in texts:
            own = words_of(text)
            lengths.append(len(own))
            words.extend(get(w, -1) for w in own)
            words.append(-1)  # no window goes on into the next text
        words = np.frombuffer(words, np.int32) if words else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        edges = np.zeros(len(words) + 1, np.int64)
        items = [set(known or ()) for _, known in before]
        for k, (had, _) in enumerate(before):
            for x in had or ():
                edges[starts[k] + x["first"]] += 1
                edges[starts[k] + x["last"] + 1] -= 1
        for t in self.tables:
            at, which = t.search(words)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + t.length, -1)
            text = np.searchsorted(starts, at, side="right") - 1
            for pair in np.unique(text * len(t.windows) + which):
                items[pair // len(t.windows)].update(self.ids[i] for i in t.items_of(pair % len(t.windows)))
        covered = np.cumsum(edges[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        turn = np.diff(covered.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
        of = np.searchsorted(starts, first, side="right") - 1
        spans = [[] for _ in texts]
        for k, a, z in zip(of.tolist(), first.tolist(), last.tolist()):
            spans[k].append({"first": a - int(starts[k]), "last": z - int(starts[k])})
        return lengths, (total[starts[1:]] - total[starts[:-1]]).tolist(), spans, items


def benchmark_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of bounded tables, read one partition at a time."""
    block, size, known = [], 0, set()
    for row in items.filter(F.col(text).isNotNull()).select(F.col(item_id), utf8(text)).toLocalIterator():
        body = bytes(row[1])
        words = words_of(body)
        more = len(words) * WORD_BYTES + len(set(words) - known) * NEW_WORD_BYTES
        if block and size + more > block_bytes:
            yield block
            block, size, known = [], 0, set()
            more = len(words) * WORD_BYTES + len(set(words)) * NEW_WORD_BYTES
        block.append((row[0], body))
        known.update(words)
        size += more
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurrences), hit_spans (merged
    first/last word positions) and item_ids (items with an occurring window, ascending)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    whole_number = isinstance(items.schema[item_id].dataType, T.IntegralType)
    id_type, arrow_id = (T.LongType(), pa.int64()) if whole_number else (T.StringType(), pa.string())
    items = items.select(F.col(item_id).cast(id_type).alias("item"), F.col(item_text).alias("text"))
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
             T.StructField("hit_spans", T.ArrayType(span)), T.StructField("item_ids", T.ArrayType(id_type))]
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = T.StructType(kept + added)
    df = docs.select(*[f.name for f in kept], F.lit(None).cast(span_type_name()).alias("hit_spans"),
                     F.lit(None).cast(T.ArrayType(id_type)).alias("item_ids"))

    def one_pass(df, block):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(block))
        names = [f.name for f in kept]

        def run(batches):
            table = resident(name, lambda: Searches(pickle.loads(shared.value), window))
            for whole in batches:
                for batch in text_slices(whole, 0, SLICE_BYTES):
                    before = list(zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist()))
                    n_words, n_hit, spans, of = table.search(batch.column(0).to_pylist(), before)
                    ids = [sorted(x - {None}) for x in of]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[1:len(names) + 1], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                         pa.array(spans, spans_type), pa.array(ids, pa.list_(arrow_id))],
                        [*names, *ADDED])

        return df.select(utf8(text).alias("__text"), *names, "hit_spans", "item_ids").mapInArrow(tidy(run), schema)

    blocks = 0
    for block in benchmark_blocks(items, "item", "text", block_bytes):
        df = one_pass(df, block)
        blocks += 1
    return df if blocks else one_pass(df, [])


def span_type_name() -> str:
    return "array<struct<first:int,last:int>>"


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents in which no window of the benchmark occurs, with the columns they had."""
    apart, back = sheltered(docs, ADDED)
    return contamination(apart, items, window=window).filter("n_hit = 0").select(*apart.columns).withColumnsRenamed(back)
