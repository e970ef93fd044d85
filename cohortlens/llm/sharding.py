"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  All groups are scheduled from the
largest to the smallest, each onto the least loaded shard, through a heap.

Groups of one size are alike to the schedule, so it runs over (size, number of groups): the shards that lie less than one size above
the least loaded one take a group each in turn, round after round, until another shard comes within reach or the groups
end.  That is the order in which the heap would hand out the groups one by one, ties by shard number.  The driver holds one entry for each
distinct size of a group: at most sqrt(2 * total bytes), as sizes differ (14 million for 100 TB), and far fewer in practice.

Groups learn their number within their size through buckets of about ``BUCKET_ROWS`` groups, offset by the buckets before them, and
from it their shard.  Rows learn it from their group: groups of at least ``total / (shards * FINE)`` bytes, of which at
most ``shards * FINE`` can exist, are broadcast, so that no key of the join over the others is hot.  Slots count within a shard
through buckets as well.

Defined cases: a null text has no bytes, its crc32 is that of no bytes, and null texts are one group; repeated rows
keep separate slots; rows are ordered by (id, crc, size) inside a bucket, so that equal rows may swap; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, utf8

ROW_OVERHEAD = 8
FINE = 1024
BUCKET_ROWS = 20_000


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int, list[int]]]]:
    """Longest-processing-time rule over (size, number of groups): per size the runs (first group, one after the last, shards that take them in
    turn)."""
    heap = [(0, s) for s in range(shards)]
    placed: dict = {}
    for size, n in sorted(sizes, reverse=True):
        runs, done = placed.setdefault(size, []), 0
        while done < n:
            turn = [heapq.heappop(heap)]
            least = turn[0][0]
            while heap and heap[0][0] < least + size:
                turn.append(heapq.heappop(heap))
            rounds = (n - done) // len(turn)
            if heap:
                rounds = min(rounds, (heap[0][0] - least) // size)
            take = rounds * len(turn) or min(n - done, len(turn))
            runs.append((done, done + take, [s for _, s in turn]))
            for k, (load, s) in enumerate(turn):
                heapq.heappush(heap, (load + size * (take // len(turn) + (k < take % len(turn))), s))
            done += take
    return placed


def shard_documents(df: DataFrame, shards: int = 24, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, size, text_crc32, shard, slot) for every row; sizes of shards are near equal."""
    spark = df.sparkSession
    body = F.coalesce(utf8(text), F.lit(b"").cast("binary"))
    rows = shared_table(df.select(F.col(row_id), (F.length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                                  F.sha2(F.when(F.col(text).isNull(), F.lit(b"null").cast("binary")).otherwise(F.concat(F.lit(b"=").cast("binary"), body)), 256)
                                  .alias("digest")), "shard-rows")
    groups = shared_table(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * FINE)))
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]  # one entry a distinct size
    runs = spark.createDataFrame(list(schedule(sizes, shards).items()), "bytes long, runs array<struct<first:long,after:long,turn:array<int>>>")
    ranked = numbered(groups, ["bytes"], ["digest"], ["digest"], "rank", runs)
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["after"]))[0]
    homes = (ranked.withColumn("run", run)
             .select("digest", "bytes", F.expr("run.turn[cast((rank - run.first) % size(run.turn) as int)]").alias("shard")))
    homes = shared_table(homes, "shard-homes")
    large = F.broadcast(homes.filter(F.col("bytes") >= least).select("digest", "shard"))  # at most shards * FINE rows
    small = homes.filter(F.col("bytes") < least).select("digest", "shard")
    sharded = rows.join(large, "digest").unionByName(rows.join(large, "digest", "left_anti").join(small, "digest"))
    return with_slots(sharded.select(row_id, "size", "text_crc32", "shard"), "shard", row_id)


def numbered(rows: DataFrame, key: list[str], spread: list[str], order: list[str], into: str, more: DataFrame | None = None) -> DataFrame:
    """Add ``into``: numbers from 0 without gaps among the rows of a key, without sorting a key in one task; and the columns of ``more``, one row a key."""
    buckets = -(-rows.count() // BUCKET_ROWS) or 1
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*key, "__bucket").agg(F.count("*").alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    if more is not None:
        offsets = offsets.join(more, key)
    inside = Window.partitionBy(*key, "__bucket").orderBy(*order)
    return (cut.withColumn("__k", F.row_number().over(inside) - 1).join(offsets, [*key, "__bucket"])
            .withColumn(into, (F.col("__before") + F.col("__k")).cast("long")).drop("__bucket", "__k", "__before"))


def with_slots(rows: DataFrame, shard: str, row_id: str) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps inside each shard."""
    return numbered(rows, [shard], [row_id, "text_crc32"], [row_id, "text_crc32", "size"], "slot")
