"""Packing token ids into fixed-length rows by best-fit decreasing.

A document longer than a row is split into pieces of the row length and a rest; nothing is cut off.  Every task
collects pieces up to ``buffer_ids`` ids and packs them: from the longest on, each piece goes to the row whose free room
is the smallest that holds it, found through a segment tree over the possible rooms.  Packing needs no shuffle, a
buffer's size does not depend on the input's, and a task that is run again gives the same rows.

Rows leave as matrices of up to ``matrix_rows`` rows: packed ids, positions that restart at 0 with every segment, and each
row's cumulative segment lengths, with the document and the piece of every segment.  ``write`` stores them as Parquet
binary columns in any folder Spark can write.

Defined cases: null or empty ids take no place; a row of the input may have a null id, which is listed as null; padding
has the id ``pad`` and position 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_LENGTH = 2048
BUFFER_IDS = 4 << 20
MATRIX_ROWS = 64
MATRICES = ("pack long, n_rows int, ids binary, positions binary, cu_seqlens array<array<int>>, "
            "doc_ids array<array<long>>, pieces array<array<int>>")


class Rooms:
    """Open rows by free room: a segment tree of counts over rooms 0 to ``most``."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``need``, removed from the tree."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to a node with something to its right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes, length: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to ``length``."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


def pack(encoded: DataFrame, width: int, pad: int, row_id: str = "doc_id", ids: str = "ids", length: int = ROW_LENGTH,
         buffer_ids: int = BUFFER_IDS, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """Matrices of packed ids (columns of ``MATRICES``) from packed id columns of ``width`` bytes an id."""
    kind = np.dtype(f"<u{width}")
    place = np.dtype("<u2" if length <= 1 << 16 else "<u4")

    def run(batches):
        serial = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        held = 0

        def flush():
            nonlocal serial
            rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for k in range(0, len(rows), matrix_rows):
                part = rows[k:k + matrix_rows]
                matrix = np.full((len(part), length), pad, kind)
                positions = np.zeros((len(part), length), place)
                ends = []
                for r, row in enumerate(part):
                    cut = [0]
                    for i in row:
                        a, n = cut[-1], len(pieces[i][2])
                        matrix[r, a:a + n] = pieces[i][2]
                        positions[r, a:a + n] = np.arange(n)
                        cut.append(a + n)
                    ends.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([matrix.tobytes()], pa.binary()),
                     pa.array([positions.tobytes()], pa.binary()), pa.array([ends], pa.list_(pa.list_(pa.int32()))),
                     pa.array([[[pieces[i][0] for i in row] for row in part]], pa.list_(pa.list_(pa.int64()))),
                     pa.array([[[pieces[i][1] for i in row] for row in part]], pa.list_(pa.list_(pa.int32())))],
                    ["pack", "n_rows", "ids", "positions", "cu_seqlens", "doc_ids", "pieces"])
                serial += 1

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                all_ids = np.frombuffer(packed.as_py() or b"", kind)
                for k in range(0, len(all_ids), length):
                    piece = all_ids[k:k + length]
                    if pieces and held + len(piece) > buffer_ids:
                        yield from flush()
                        pieces, held = [], 0
                    pieces.append((own, k // length, piece))
                    held += len(piece)
        if pieces:
            yield from flush()

    return encoded.select(F.col(row_id).cast("long"), F.col(ids)).mapInArrow(run, MATRICES)


def write(matrices: DataFrame, path: str) -> None:
    matrices.write.mode("overwrite").parquet(path)


def rows_of(matrices: DataFrame, width: int, length: int = ROW_LENGTH) -> DataFrame:
    """One row per packed row: its place, segments, ids and positions as binary."""
    each = matrices.select("pack", "ids", "positions", F.posexplode(F.arrays_zip("cu_seqlens", "doc_ids", "pieces")).alias("row", "s"))
    spot = 2 if length <= 1 << 16 else 4

    def cut(column, size):
        return F.expr(f"substring({column}, row * {length * size} + 1, {length * size})").alias(column)

    return each.select("pack", "row", F.col("s.cu_seqlens").alias("cu_seqlens"), F.col("s.doc_ids").alias("doc_ids"),
                       F.col("s.pieces").alias("pieces"), cut("ids", width), cut("positions", spot))
