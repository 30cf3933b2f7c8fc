"""Sharding by longest-processing-time scheduling; rows of equal text stay together and shard sizes are near equal.

A row's size is its text's UTF-8 bytes and OVERHEAD more. Groups (equal texts; null counts as the empty one) go by
falling size, each to the least-loaded shard, through a heap. Groups of one size are interchangeable, so the schedule
needs no more than the number of groups of each size: a distinct size and its count reach the driver, at most
sqrt(2 * total bytes) of them, and a size that very many groups have is scheduled in one step that gives what the heap
would. The result says how many groups of a size each shard takes; groups are numbered among those of their size, and
the number decides. Groups are known by a 64-bit hash of the text; texts that share a hash merely stay together.

Numbers without gaps (of a size's groups, of a shard's rows) come from counts by (block, key) first, a block being a
place in a staged table, and row numbers within it, so no task needs all rows of a key.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common

#: Bytes that a row costs besides its text.
OVERHEAD = 8
#: Rows of a block, about.
BLOCK = 20_000
#: Groups of one size, for each shard, from which they are scheduled in one step.
BULK = 16


def bulk(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of count things of a size each shard gets if each goes to the least-loaded shard, the first of equals:
    those whose loads before they come, loads + size * k, are the count smallest."""
    taken = lambda level: np.maximum(0, -((loads - level) // size))  # noqa: E731  loads below level
    low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
    while high - low > 1:  # the highest level with at most count things that come below it
        level = (low + high) // 2
        low, high = (level, high) if int(taken(level).sum()) <= count else (low, level)
    got = taken(low)
    left = count - int(got.sum())
    got[np.flatnonzero(loads + got * size == low)[:left]] += 1
    return got


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Longest processing time for (size, number of groups of that size), sizes distinct: (size, first number, number
    behind the last, shard), so that a size's groups are numbered from 0; ties go to the smaller shard number."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        if count <= BULK * shards:
            got: dict[int, int] = Counter()
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                got[shard] += 1
        else:
            loads = np.array([load for load, _ in sorted(heap, key=lambda x: x[1])], np.int64)
            more = bulk(loads, size, count)
            got = {s: int(n) for s, n in enumerate(more) if n}
            heap = list(zip((loads + more * size).tolist(), range(shards), strict=True))
            heapq.heapify(heap)
        at = 0
        for shard in sorted(got):
            out.append((size, at, at + got[shard], shard))
            at += got[shard]
    return out


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows, which are staged, with a number from 0 without gaps among those of their key."""
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("__at"), F.lit(max(1, -(-rows.count() // BLOCK)))))
    before = rows.groupBy("__block", key).agg(F.count("*").alias("__rows"))
    before = before.withColumn("__base", F.sum("__rows").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    within = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__block", key).orderBy("__at")))
    out = within.join(before.drop("__rows"), ["__block", key])
    return out.withColumn(name, (F.coalesce("__base", F.lit(0)) + F.col("__n") - 1).cast("long")).drop("__at", "__block", "__n", "__base")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs: law is `bytes`, grown_shard null.

    Null texts have size OVERHEAD and checksum 0; null and repeated ids are rows like any other; an empty table
    gives no rows; very long texts are groups like any other. Other columns are ignored."""
    spark = docs.sparkSession
    common.ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
    )
    rows = common.stage(rows, "shard-rows")
    groups = common.stage(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = groups.groupBy("bytes").count().toArrow()
    plan = schedule(list(zip(sizes["bytes"].to_pylist(), sizes["count"].to_pylist(), strict=True)), shards)
    names = ("bytes", "low", "high", "shard")
    columns = pa.table({n: pa.array([r[i] for r in plan], pa.int64()) for i, n in enumerate(names)})
    # staged, so that it is dealt with the groups, and a size that very many groups have can be split; sent to all
    # tasks only where it is small
    planned = common.stage(spark.createDataFrame(columns).withColumn("shard", F.col("shard").cast("int")), "shard-plan")
    ranked = common.stage(_numbered(groups, "bytes", "rank"), "shard-ranked")
    assigned = ranked.join(planned, (ranked["bytes"] == planned["bytes"]) & (ranked["rank"] >= planned["low"]) & (ranked["rank"] < planned["high"]))
    assigned = common.stage(assigned.select("group", "shard"), "shard-assigned")
    placed = common.stage(rows.join(assigned, "group").select(id_col, "size", "text_crc32", "shard"), "shard-placed")
    for old in (groups, planned, ranked, assigned, rows):
        common.unstage(old)
    out = _numbered(placed, "shard", "slot")
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
