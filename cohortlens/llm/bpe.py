"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex.  Every code point gets a class; white space and
apostrophes are refined by what follows them.  An eight-state automaton reads the
classes.  Its class functions generate a small transition monoid, so the state
before every character is an associative scan: blocks are scanned side by side,
block totals are combined, and the states are looked up.  The resulting slices go
to pair merging behind a per-process cache; token byte offsets are kept.

Defined cases: null and empty texts give no ids; malformed UTF-8 is read with
replacement characters; very long unbroken pieces are merged with a heap in
O(n log n); other columns of the input are kept unless they have the name of a
column that this operator adds, which is then replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, small_batches, text_slices, tidy, utf8

# states
FRESH, LETTERS, DIGITS, OTHERS, SPACE, BLANKS, TAKE1, TAKE2 = range(8)
# classes; CONTR2 / CONTR3: apostrophe with a contraction of that length behind it;
# BLANK: white space with white space or the end behind it; LAST_SPACE / LAST_BLANK: the
# last of its run, with something behind it; STOP: between two texts
LETTER, DIGIT, OTHER, CONTR2, CONTR3, BLANK, LAST_SPACE, LAST_BLANK, STOP = range(9)
BLOCK = 512
SLICE_BYTES = 1 << 19
CACHE_ENTRIES = 200_000
CACHED_PIECE = 64
LONG_PIECE = 96
MERGED_AT_ONCE = 4096
WIDTHS = [-(-n // 5) if n <= 20 else n.bit_length() + 5 for n in range(LONG_PIECE + 1)]
FAR = (1 << 31) - 1  # no rank is as high
SHORT_PIECE = 7
EMPTY = np.uint64((1 << 64) - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MAX_RANK_FILE = 64 << 20


def _transitions():
    """nxt[class, state] and starts[class, state]: does the character begin a token?"""
    nxt = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for state in range(8):
        nxt[LETTER, state] = {TAKE2: TAKE1, TAKE1: FRESH}.get(state, LETTERS)
        starts[LETTER, state] = state not in (LETTERS, SPACE, TAKE1, TAKE2)
        nxt[DIGIT, state] = DIGITS
        starts[DIGIT, state] = state not in (DIGITS, SPACE)
        for cls, then in ((OTHER, OTHERS), (CONTR2, TAKE1), (CONTR3, TAKE2)):
            glued = state in (OTHERS, SPACE)
            nxt[cls, state] = OTHERS if glued else then
            starts[cls, state] = not glued
        nxt[BLANK, state] = BLANKS
        starts[BLANK, state] = state != BLANKS
        nxt[LAST_SPACE, state] = SPACE
        nxt[LAST_BLANK, state] = FRESH
        nxt[STOP, state] = FRESH
    return nxt, starts


def _monoid(generators: np.ndarray):
    """Close the class functions under composition: functions[id][state], the id of
    each class, and compose[a, b] = first a, then b."""
    seen: dict[bytes, int] = {}
    functions: list[np.ndarray] = []

    def add(f):
        key = f.tobytes()
        if key not in seen:
            seen[key] = len(functions)
            functions.append(f)
        return seen[key]

    ids = [add(g) for g in generators]
    done = 0
    while done < len(functions):
        f = functions[done]
        for g in generators:
            add(g[f])
        done += 1
    table = np.zeros((len(functions), len(functions)), np.uint8)
    for a, f in enumerate(functions):
        for b, g in enumerate(functions):
            table[a, b] = seen[g[f].tobytes()]
    return np.array(functions, np.uint8), np.array(ids, np.uint8), table


NEXT, STARTS = _transitions()
FUNCTIONS, CLASS_FUNCTION, COMPOSE = _monoid(NEXT)
_POINT_CLASS: np.ndarray | None = None


def point_classes() -> np.ndarray:
    """Class of every code point: \\p{L}, \\p{N}, White_Space, anything else."""
    global _POINT_CLASS
    if _POINT_CLASS is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for p in range(0x110000):
            major = unicodedata.category(chr(p))[0]
            if major == "L":
                table[p] = LETTER
            elif major == "N":
                table[p] = DIGIT
        # fixed values: letters and numbers that Unicode 16 has and this Python's tables may lack
        letters = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
                   (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
                   (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
                   (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
                   (0x1E5F0, 0x1E5F0)]
        numbers = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                   (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
        for ranges, cls in ((letters, LETTER), (numbers, DIGIT)):
            for low, high in ranges:
                table[low:high + 1] = cls
        # fixed values: Unicode's White_Space property
        blanks = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[blanks] = BLANK
        _POINT_CLASS = table
    return _POINT_CLASS


def classify(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Classes of a text in which ``stops`` marks the separators between documents."""
    cls = point_classes()[points]
    cls[stops] = STOP
    follow = np.empty_like(cls)
    follow[:-1], follow[-1] = cls[1:], STOP
    last = (cls == BLANK) & (follow != BLANK) & (follow != STOP)
    cls[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero(points == 0x27)
    at = at[cls[at] == OTHER]
    if len(at):
        ahead = np.concatenate([np.where(stops, 0, points), np.zeros(2, points.dtype)])
        one, two = ahead[at + 1], ahead[at + 2]
        c = np.frombuffer("stmdrvel".encode("utf-32-le"), points.dtype)
        short = np.isin(one, c[:4])
        long = ((one == c[4]) | (one == c[5])) & (two == c[6]) | (one == c[7]) & (two == c[7])
        cls[at[short]] = CONTR2
        cls[at[long]] = CONTR3
    return cls


def states_before(cls: np.ndarray) -> np.ndarray:
    """State of the automaton before every character: a blocked scan of functions."""
    n = len(cls)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, CLASS_FUNCTION[STOP], np.uint8)
    padded[:n] = CLASS_FUNCTION[cls]
    by_step = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    prefix = np.empty_like(by_step)
    prefix[0] = by_step[0]
    for k in range(1, BLOCK):
        prefix[k] = COMPOSE[prefix[k - 1], by_step[k]]
    enter = np.empty(rows, np.uint8)
    state = FRESH
    for r, f in enumerate(prefix[-1].tolist()):
        enter[r] = state
        state = FUNCTIONS[f, state]
    before = np.empty((rows, BLOCK), np.uint8)
    before[:, 0] = enter
    before[:, 1:] = FUNCTIONS[prefix[:-1].T, enter[:, None]]
    return before.reshape(-1)[:n]


def piece_starts(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    cls = classify(points, stops)
    begins = STARTS[cls, states_before(cls)]
    begins[stops] = True
    return np.flatnonzero(begins)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file in the ``base64 rank`` form."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def id_type(ranks: dict[bytes, int]) -> np.dtype:
    return np.dtype("<u2" if max(ranks.values(), default=0) < (1 << 16) - 1 else "<u4")


class Words:
    """Token bytes by id, for decoding."""

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        self.dtype = id_type(ranks)
        self.words = {i: w for w, i in ranks.items()}
        self.sizes = np.zeros(1 + max(self.words, default=-1), np.int64)
        for i, w in self.words.items():
            self.sizes[i] = len(w)

    def check(self, ids: bytes | None, offsets: np.ndarray) -> None:
        """Refuse piece offsets that are not ascending, from 0 on, at first bytes of tokens."""
        sizes = self.sizes[np.frombuffer(ids or b"", self.dtype)]
        starts = np.cumsum(sizes) - sizes
        right = len(offsets) <= len(starts) and starts[:1].tolist() == offsets[:1].tolist() and (np.diff(offsets) > 0).all()
        if not right or not np.array_equal(starts[np.minimum(np.searchsorted(starts, offsets), max(len(starts) - 1, 0))], offsets):
            raise ValueError("piece offsets do not fit the ids")

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids or b"", self.dtype).tolist()))

    def decimal(self, ids: bytes | None) -> str:
        """Decimal ids joined by commas."""
        return str(np.frombuffer(ids or b"", self.dtype).tolist())[1:-1].replace(" ", "")


class Ranks:
    """Merge ranks of a vocabulary, for encoding."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.dtype = id_type(self.ranks)
        if max(self.ranks.values()) >= FAR:
            raise ValueError(f"ranks from {FAR} on are not supported")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.probe = self._probe_table()
        self.of_bytes = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256))  # of two bytes, by 256 * first + second
        self.cache: dict[bytes, bytes] = {}

    def _probe_table(self):
        """Pair ranks as an open-addressed table for array lookups: keys, ranks, longest probe."""
        known = [((self.ranks[w[:k]] << 32) | self.ranks[w[k:]], i) for w, i in self.ranks.items()
                 for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        pairs = np.array([k for k, _ in known], np.uint64)
        ranks = np.array([i for _, i in known], np.int32)
        bits = max(8, int(4 * len(pairs)).bit_length())
        keys, values = np.full(1 << bits, EMPTY, np.uint64), np.full(1 << bits, FAR, np.int32)
        slot, left, longest = (pairs * SPREAD) >> np.uint64(64 - bits), np.arange(len(pairs)), 0
        while len(left):
            longest += 1
            _, first = np.unique(slot[left], return_index=True)
            first = left[first]
            first = first[keys[slot[first]] == EMPTY]
            keys[slot[first]], values[slot[first]] = pairs[first], ranks[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        return keys, values, np.uint64(64 - bits), longest

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every adjacent pair; FAR where there is none (-1 stands beyond the piece)."""
        keys, values, shift, longest = self.probe
        out = np.full(len(a), FAR, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        want = (a[at].astype(np.uint64) << np.uint64(32)) | b[at].astype(np.uint64)
        slot = (want * SPREAD) >> shift
        for _ in range(longest):
            held = keys[slot]
            hit = held == want
            out[at[hit]] = values[slot[hit]]
            on = ~hit & (held != EMPTY)
            if not on.any():
                break
            at, want, slot = at[on], want[on], (slot[on] + np.uint64(1)) & np.uint64(len(keys) - 1)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of similar length, merged side by side: in every round each
        piece joins its pair of lowest rank, the leftmost first."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(width + 1, dtype=np.int32)
        raw = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(n, width + 1)
        ids = np.where(column < size[:, None], self.single[raw], np.int32(-1))
        after = np.minimum(column + 1, width) + np.zeros((n, 1), np.int32)
        ahead = column - 1 + np.zeros((n, 1), np.int32)
        ranks = np.full((n, width + 1), FAR, np.int32)
        ranks[:, :-1] = np.where(ids[:, 1:] >= 0, self.of_bytes[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]], FAR)
        rows = np.arange(n)
        while len(rows):
            i = (ranks if len(rows) == n else ranks[rows]).argmin(axis=1)
            low = ranks[rows, i]
            on = low != FAR
            rows, i, low = rows[on], i[on], low[on]
            if not len(rows):
                break
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = low, -1
            ranks[rows, j] = FAR
            after[rows, i], ahead[rows, k] = k, i
            ranks[rows, i] = self.pair_ranks(low, ids[rows, k])
            h = ahead[rows, i]
            some = h >= 0
            r, h = rows[some], h[some]
            ranks[r, h] = self.pair_ranks(ids[r, h], low[some])
        kept = ids >= 0
        packed = ids[kept].astype(self.dtype).tobytes()
        cut = (np.concatenate([[0], np.cumsum(kept.sum(axis=1))]) * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip(cut, cut[1:])]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of any pieces."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(self.dtype.itemsize, "little")
            elif len(piece) > LONG_PIECE:
                ids = self._merge_long(self.single[np.frombuffer(piece, np.uint8)].tolist())
                out[i] = np.array(ids, self.dtype).tobytes()
            else:
                by_width.setdefault(WIDTHS[len(piece)], []).append(i)
        for group in by_width.values():
            for k in range(0, len(group), MERGED_AT_ONCE):
                part = group[k:k + MERGED_AT_ONCE]
                for i, ids in zip(part, self.merge_many([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()  # of each position's pair
        heap = [(r, i) for i, r in enumerate(ranks) if r != FAR]
        heapq.heapify(heap)
        ranks.append(FAR)
        known: dict[tuple, int] = {}

        def rank(a, b):
            if (a, b) not in known:
                known[a, b] = int(self.pair_ranks(np.array([a]), np.array([b]))[0])
            return known[a, b]

        while heap:
            low, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != low:
                continue  # one of the pair has been joined meanwhile
            j = after[i]
            ids[i], ids[j], after[i] = low, -1, after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (i, ahead[i]):
                if k >= 0:
                    ranks[k] = rank(ids[k], ids[after[k]]) if after[k] < n else FAR
                    if ranks[k] != FAR:
                        heapq.heappush(heap, (ranks[k], k))
        return [i for i in ids if i >= 0]

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece.  The cache is emptied when full; that changes no result."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out = list(map(cache.get, pieces))
        missed = [i for i, ids in enumerate(out) if ids is None]
        new = list({pieces[i] for i in missed})
        found = dict(zip(new, self.merge(new)))
        for i in missed:
            out[i] = found[pieces[i]]
        cache.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_PIECE)
        return out

    def ids_of(self, raw: bytes, cut: np.ndarray) -> list[bytes]:
        """Packed ids of the pieces of ``raw`` that begin at ``cut``.  Short ones are told apart by one number, their bytes and length, so that each
        distinct one is cut out and looked up once."""
        sizes = np.diff(cut, append=len(raw))
        words = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from every place on
        short = sizes <= SHORT_PIECE
        at = np.flatnonzero(short)
        bits = sizes[at].astype(np.uint64) << np.uint64(3)
        keys = words[cut[at]] & ((np.uint64(1) << bits) - np.uint64(1)) | sizes[at].astype(np.uint64) << np.uint64(56)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at, others = at[first], np.flatnonzero(~short)
        place = np.empty(len(cut), np.int64)
        place[short] = which
        place[others] = np.arange(len(at), len(at) + len(others))
        each = np.concatenate([at, others])
        begin = cut[each]
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + sizes[each]).tolist())]
        return list(map(self.lookup(pieces).__getitem__, place.tolist()))

    def encode(self, texts: list[bytes | None], offsets: bool = True) -> list[tuple[bytes, np.ndarray | None]]:
        """For each text: packed ids, and, where wanted, byte offsets of its pieces."""
        strings = [(t or b"").decode("utf-8", "replace") for t in texts]
        joined = "\0".join(strings) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        stops = np.zeros(len(points), bool)
        stops[ends] = True
        starts = piece_starts(points, stops)
        raw = joined.encode("utf-8")
        cut = starts
        if len(raw) != len(points):
            width = np.ones(len(points), np.uint8)
            for low in (0x80, 0x800, 0x10000):
                width += points >= low
            cut = (np.cumsum(width, dtype=np.int64) - width)[starts]
        ids = self.ids_of(raw, cut)
        cut = cut.tolist() if offsets else cut
        out, first = [], 0
        for end in np.searchsorted(starts, ends).tolist():  # where each text's separator stands
            places = np.array(cut[first:end], np.int64) if offsets else None
            out.append((b"".join(ids[first:end]), places - places[0] if offsets and len(places) else places))
            first = end + 1
        return out


class SharedRanks:
    """A broadcast rank file; each Python worker builds one table and keeps it between tasks."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read(MAX_RANK_FILE + 1)
        if len(data) > MAX_RANK_FILE:
            raise ValueError(f"{path}: a rank file of over {MAX_RANK_FILE} bytes is not broadcast")
        self.digest = hashlib.sha256(data).digest()
        self.data = spark.sparkContext.broadcast(data)

    def table(self, kind):
        """The worker's ``Ranks`` or ``Words`` of this file."""
        return resident((kind.__name__, self.digest), lambda: kind(self.data.value))


def vocabulary_size(path: str) -> int:
    """One more than the highest id: the first id that no token has."""
    with open(path, "rb") as f:
        return 1 + max((int(x.split()[1]) for x in f if x.strip()), default=-1)


def id_bytes(path: str) -> int:
    """Bytes of one id in the packed form."""
    return 2 if vocabulary_size(path) < 1 << 16 else 4  # with room for one id beyond the vocabulary


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add ``ids`` (little-endian unsigned integers of ``id_bytes(path)`` bytes), ``n_tokens``
    and, on demand, ``piece_offsets`` (first byte of every pre-token).  The text column is replaced by these.
    Texts are encoded in slices of about ``slice_bytes``: larger ones share more work and hold more memory."""
    small_batches(df.sparkSession)
    shared = SharedRanks(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text, "ids", "n_tokens", "piece_offsets")]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep]
                          + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
                          + ([T.StructField("piece_offsets", T.ArrayType(T.LongType()))] if offsets else []))

    def run(batches):
        ranks = shared.table(Ranks)
        for whole in batches:
            for batch in text_slices(whole, 0, slice_bytes):
                done = ranks.encode(batch.column(0).to_pylist(), offsets)
                cols = batch.columns[1:] + [pa.array([i for i, _ in done], pa.binary()),
                                            pa.array([len(i) // ranks.dtype.itemsize for i, _ in done], pa.int64())]
                names = [*keep, "ids", "n_tokens"]
                if offsets:
                    cols.append(pa.array([o for _, o in done], pa.list_(pa.int64())))
                    names.append("piece_offsets")
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(utf8(text).alias("__text"), *keep).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", offsets: str | None = None, decimal: str | None = None) -> DataFrame:
    """Add ``into``: the bytes of the packed ids; null ids give no bytes.  With ``offsets``, the column of the pieces' first bytes, these
    must stand at first bytes of tokens in what is decoded (null offsets are not checked).  With ``decimal``, a column of this name is added too:
    the decimal ids joined by commas, as ``id_text`` writes them."""
    small_batches(df.sparkSession)
    shared = SharedRanks(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (into, decimal)]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(into, T.BinaryType())]
                          + ([T.StructField(decimal, T.StringType())] if decimal else []))
    at = keep.index(ids)

    def run(batches):
        words = shared.table(Words)
        for whole in batches:
            for batch in text_slices(whole, at, SLICE_BYTES):
                if offsets:
                    column = batch.column(keep.index(offsets))
                    cuts, values = column.offsets.to_numpy(), column.values.to_numpy()
                    for i, packed in enumerate(batch.column(at).to_pylist()):
                        if column[i].is_valid:
                            words.check(packed, values[cuts[i]:cuts[i + 1]])
                packed = batch.column(at).to_pylist()
                cols, names = [*batch.columns, pa.array(map(words.decode, packed), pa.binary())], [*keep, into]
                if decimal:
                    cols.append(pa.array(map(words.decimal, packed), pa.string()))
                    names.append(decimal)
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(*keep).mapInArrow(tidy(run), schema)


def id_text(ids, width: int):
    """Decimal ids joined by commas, from the packed column, in Spark functions."""
    text = F.hex(ids)
    digits = 2 * width
    order = "".join(f"${k}" for k in range(width, 0, -1))  # little-endian bytes to a big-endian number
    one = "".join(["(..)"] * width)
    swapped = F.regexp_replace(text, one, order)
    parts = F.regexp_extract_all(swapped, F.lit(f"(.{{{digits}}})"))
    return F.concat_ws(",", F.transform(parts, lambda h: F.conv(h, 16, 10)))
