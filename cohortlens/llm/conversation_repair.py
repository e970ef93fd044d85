"""Repair of turn order in conversations: bidirectional Dijkstra over the edit lattice.

A conversation's rows, by turn, are the layers of a lattice; its states say which role came last (none yet, system, user, assistant).
Edits are its edges: Keep 0, Rerole 1, Delete 2, Insert an empty user or assistant row 5; a truncated row that stays costs 5 more; blank and
repeated rows have to go.  A path ends with nothing kept or with an assistant, so that the initials read ``(s?(ua)+)?``.

Per block, a forward heap starts at the block's entry and a reverse heap at its exits.  They meet, all crossings of equal cost are finished, and
of all cheapest paths the one with the least audit (the edits' initials) is read off the two halves.  At a node every edit has a letter of its own, so
the least audit is found letter by letter and no strings are compared.

Where it runs.  Rows are numbered within their conversation by a distributed prefix sum.  A lattice is cut into blocks of ``BLOCK`` rows, so no
task ever holds a whole conversation:

1. every block but the first tells what it costs from each of its four entries to each of its four exits;
2. these small tables, read from the last block to the first, give what is still to pay at each exit;
3. every block finds its least audit from each entry (the first has one entry only);
4. one ordered pass over rows and audits follows the entries and writes the repaired rows and the digest, a row at a time.

Order of rows with equal turns: role, then text, then the copy's number.  Defined cases: nulls count as one space, in every column (a null conversation
id is one conversation); an empty role has no initial; a conversation of which nothing is left has zeros and an empty audit; other columns are not used.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordering import global_row_number

from .common import shared_table, small_batches, tidy

BLOCK = 2000
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = frozenset(("su", "ua", "au"))
END = (0, 10, 5, 0)  # what trailing insertions cost from each state
NEVER = 1 << 60
SPACE = r"[^\x20\x09-\x0D]"
OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Lattice:
    """Layers 0..n of four states each and a sink behind the last layer; ``exits`` is the cost from there on."""

    def __init__(self, rows: list[tuple[str, int]], exits=None):
        self.rows, self.n, self.exits = rows, len(rows), exits
        self.sink = 4 * (self.n + 1)

    def kept_state(self, state: int, initial: str):
        """The state after keeping a row, or None where the order forbids it."""
        if initial == "u":
            return USER if state != USER else None
        if initial == "a":
            return ASSISTANT if state == USER else None
        return SYSTEM if initial == "s" and state == START else None

    def after(self, node: int) -> list[tuple[int, int, str]]:
        """(next node, cost, letter)."""
        layer, state = divmod(node, 4)
        if layer == self.n:
            return [(self.sink, self.exits[state], "")] if self.exits[state] < NEVER else []
        initial, fault = self.rows[layer]
        below = 4 * (layer + 1)
        out = [(below + state, 2, "D"), (4 * layer + FOLLOW[state], 5, "I")]
        if fault in (FINE, TRUNCATED):
            more = 5 if fault == TRUNCATED else 0
            kept = self.kept_state(state, initial)
            if kept is not None:
                out.append((below + kept, more, "K"))
            out.append((below + FOLLOW[state], 1 + more, "R"))
        return out

    def before(self, node: int) -> list[tuple[int, int]]:
        """(earlier node, cost)."""
        if node == self.sink:
            return [(4 * self.n + q, c) for q, c in enumerate(self.exits) if c < NEVER]
        layer, state = divmod(node, 4)
        out = []
        if layer < self.n:
            out += [(4 * layer + q, 5) for q in range(4) if FOLLOW[q] == state]
        if layer:
            above = 4 * (layer - 1)
            initial, fault = self.rows[layer - 1]
            out.append((above + state, 2))
            if fault in (FINE, TRUNCATED):
                more = 5 if fault == TRUNCATED else 0
                out += [(above + q, more) for q in range(4) if self.kept_state(q, initial) == state]
                out += [(above + q, 1 + more) for q in range(4) if FOLLOW[q] == state]
        return out

    def costs_to(self, exit_state: int) -> list[int]:
        """Cost from every entry to one exit, by the reverse heap alone."""
        far = {4 * self.n + exit_state: 0}
        heap, done = [(0, 4 * self.n + exit_state)], set()
        while heap:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for earlier, cost in self.before(node):
                if d + cost < far.get(earlier, NEVER):
                    far[earlier] = d + cost
                    heapq.heappush(heap, (d + cost, earlier))
        return [far.get(q, NEVER) for q in range(4)]

    def repair(self, entry: int) -> tuple[int, str, int]:
        """(cost with what follows the block, least audit, exit state) from one entry."""
        ahead, back = {entry: 0}, {self.sink: 0}
        forward, reverse = [(0, entry)], [(0, self.sink)]
        seen, met = set(), set()  # settled by the forward and by the reverse heap
        best = NEVER
        while forward or reverse:
            low = forward[0][0] if forward else NEVER
            high = reverse[0][0] if reverse else NEVER
            if met and low + high > best:  # equal costs go on, until every cheapest path has crossed
                break
            if forward and (low <= high or not reverse):
                d, node = heapq.heappop(forward)
                if node in seen:
                    continue
                seen.add(node)
                for following, cost, _ in self.after(node):
                    if following in back:
                        best = min(best, d + cost + back[following])
                    if following != self.sink and d + cost < ahead.get(following, NEVER):
                        ahead[following] = d + cost
                        heapq.heappush(forward, (d + cost, following))
            else:
                d, node = heapq.heappop(reverse)
                if node in met:
                    continue
                met.add(node)
                for earlier, cost in self.before(node):
                    if earlier in seen:
                        best = min(best, ahead[earlier] + cost + d)
                    if d + cost < back.get(earlier, NEVER):
                        back[earlier] = d + cost
                        heapq.heappush(reverse, (d + cost, earlier))
        return (best, *self._least(entry, ahead, back, seen, met, best))

    def _least(self, entry, ahead, back, seen, met, best) -> tuple[str, int]:
        """The least audit among all paths of cost ``best``."""
        # nodes of the forward half that lie on a cheapest path: those before a crossing, and what leads to them
        marked = {u for u in seen if any(v in met and ahead[u] + c + back[v] == best for v, c, _ in self.after(u))}
        open_ = list(marked)
        while open_:
            node = open_.pop()
            for earlier, cost in self.before(node):
                if earlier in seen and earlier not in marked and ahead[earlier] + cost == ahead[node]:
                    marked.add(earlier)
                    open_.append(earlier)
        letters, node = [], entry
        while True:
            if node in marked:
                ways = [(letter, v) for v, c, letter in self.after(node)
                        if (v in marked and ahead[node] + c == ahead[v]) or (v in met and ahead[node] + c + back[v] == best)]
            else:
                ways = [(letter, v) for v, c, letter in self.after(node) if v in met and back[node] == c + back[v]]
            letter, following = min(ways)
            if following == self.sink:
                return "".join(letters), node - 4 * self.n
            letters.append(letter)
            node = following


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows with the faults that crc32 of ``conv_id:turn`` deals out."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    return (rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
            .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, fault) of rows (conv_id, turn, role, text, copy), numbered from 1 in each conversation."""
    placed = global_row_number(rows.select("conv_id", "turn", "role", "text", "copy"), ["turn", "role", "text", "copy"], ["conv_id"], name="pos")
    placed = placed.drop("copy").withColumn("mark", F.sha2("text", 256))
    firsts = (placed.groupBy("conv_id", "role", "mark").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
              .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first"))
    last = F.expr(r"right(trim(TRAILING ' \t\n\u000B\f\r' FROM text), 1)")
    fault = (F.when(~F.col("text").rlike(SPACE), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE)
             .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    # one row a repeated message; a message that fills a conversation is split by the adaptive join
    joined = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    return shared_table(joined.select("conv_id", "pos", "turn", "role", "text", fault.alias("fault")), "conversation-rows")


def _runs(batches, names):
    """(leading values, rows) for runs of equal leading columns in ordered batches; a run is a block."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    yield from itertools.groupby(rows(), key=lambda r: r[:names])


def _entry_costs(batches):
    """Per block the cost from each entry to each exit, exits first."""
    for (conv, block), rows in _runs(batches, 2):
        lattice = Lattice([(r[3], r[4]) for r in rows])
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": block, "costs": [c for q in range(4) for c in lattice.costs_to(q)]}],
                                         pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _still_to_pay(batches):
    """Blocks from last to first: what is to be paid from each exit of the block before."""
    held, key = END, None
    for (conv,), rows in _runs(batches, 1):
        if conv != key or key is None:
            held, key = END, conv
        for _, block, costs in rows:
            held = tuple(min(min(costs[4 * q + e] + held[q] for q in range(4)), NEVER) for e in range(4))
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": block - 1, "exits": list(held)}],
                                             pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("exits", pa.list_(pa.int64()))]))


OPTIONS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int64()))])


def _options(size: int):
    """Per block and entry: the cost to the conversation's end, the block's least audit and its exit."""
    def run(batches):
        held = []
        for (conv, block), rows in _runs(batches, 2):
            rows = list(rows)
            lattice = Lattice([(r[3], r[4]) for r in rows], rows[0][5] or END)
            found = [lattice.repair(q) if block or q == START else (0, "", START) for q in range(4)]
            held.append({"conv_id": conv, "pos": block * size + 1, "costs": [f[0] for f in found], "audits": [f[1] for f in found], "ends": [f[2] for f in found]})
            if len(held) >= 500 or len(rows) >= size:
                yield pa.RecordBatch.from_pylist(held, OPTIONS)
                held = []
        yield pa.RecordBatch.from_pylist(held, OPTIONS)
    return run


class Repaired:
    """One conversation as its rows pass by."""

    def __init__(self, conv):
        self.conv, self.digest, self.begun = conv, hashlib.sha256(), False
        self.counts, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.least = self.most = self.turn = None
        self.turns = self.cost = 0
        self.state, self.letters, self.audit, self.opened = START, iter(""), [], False

    def write(self, role: str, text: str):
        self.digest.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def insert(self):
        self.state = FOLLOW[self.state]
        self.write(ROLE[self.state], "")

    def block(self, costs, audits, ends):
        if not self.opened:
            self.cost, self.opened, self.at = costs[START], True, START
        self.letters = iter(audits[self.at])
        self.audit.append(audits[self.at])
        self.at = ends[self.at]

    def row(self, turn, role, text, fault):
        self.counts[fault] += 1
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.least, self.most, self.turn = (turn if self.least is None else self.least), turn, turn
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        letter = next(self.letters)
        while letter == "I":
            self.insert()
            letter = next(self.letters)
        if letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            self.write(role, text)
        elif letter == "R":
            self.state = FOLLOW[self.state]
            self.write(ROLE[self.state], text)

    def result(self) -> dict:
        while self.state in (SYSTEM, USER):  # trailing insertions
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
                "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repaired(batches):
    """Rows ordered by conversation and place, each conversation opened by a marker and each block by its options."""
    now, held = None, []
    for batch in batches:
        for conv, _, kind, turn, role, text, fault, costs, audits, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if now:
                    held.append(now.result())
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_pylist(held, RESULT)
                        held = []
                now = Repaired(conv)
            elif kind == 1:
                now.block(costs, audits, ends)
            else:
                now.row(turn, role, text, fault)
    if now:
        held.append(now.result())
    yield pa.RecordBatch.from_pylist(held, RESULT)


def repair(conversations: DataFrame, damaged: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row a conversation of ``conversations`` (conv_id, turn, role, text): its faults, the cheapest repair's cost and audit, and the digest of
    the repaired rows.  ``damaged`` are the rows to repair, with ``copy``; where not given, the conversations' own."""
    small_batches(conversations.sparkSession)
    if damaged is None:
        def spaced(c):
            return F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        damaged = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), F.lit(0).alias("copy"))
    rows = faults(damaged)
    slim = rows.select("conv_id", F.expr(f"(pos - 1) div {block}").alias("block"), "pos", F.substring("role", 1, 1).alias("initial"), "fault")

    def together(df, keys, *order):
        return df.repartition(*keys).sortWithinPartitions(*order)

    inner = together(slim.filter("block > 0"), ["conv_id", "block"], "conv_id", "block", "pos")
    costs = inner.mapInArrow(tidy(_entry_costs), "conv_id long, block long, costs array<long>")
    exits = (together(costs, ["conv_id"], "conv_id", F.desc("block")).mapInArrow(tidy(_still_to_pay), "conv_id long, block long, exits array<long>")
             .withColumnsRenamed({"conv_id": "c", "block": "b"}))
    met = slim.join(exits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    options = together(met, ["conv_id", "block"], "conv_id", "block", "pos").mapInArrow(
        tidy(_options(block)), "conv_id long, pos long, costs array<long>, audits array<string>, ends array<long>")

    columns = {"conv_id": "long", "pos": "long", "kind": "int", "turn": "long", "role": "string", "text": "string", "fault": "int",
               "costs": "array<long>", "audits": "array<string>", "ends": "array<long>"}

    def padded(df):
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    markers = conversations.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(0).alias("pos"), F.lit(0).alias("kind"))
    everything = padded(markers).union(padded(options.withColumn("kind", F.lit(1)))).union(padded(rows.withColumn("kind", F.lit(2))))
    return together(everything, ["conv_id"], "conv_id", "pos", "kind").mapInArrow(tidy(_repaired), OUT)
