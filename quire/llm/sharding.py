"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups are ordered by size and go, largest first, to the
shard with the least load, taken from a heap. Only a histogram of size classes reaches the driver. Sizes below
2**CLASS_BITS are classes of their own and larger ones keep their leading CLASS_BITS bits, so there are at most some
2**(CLASS_BITS - 1) classes for each doubling, however many groups there are. Groups of a class are alike to the
schedule, which hands out a whole class at once: the number that each shard gets is what the heap would have given one
by one. A group finds its shard by its rank in its class.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, global_rank, split_join

CLASS_BITS = 12
OVERHEAD = 16


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[list[int]]:
    """For each class (size, groups, bytes), largest size first, how many of its groups each shard gets."""
    loads = [0.0] * shards
    out = []
    for _, groups, size in classes:
        mean, given = size / groups, [0] * shards
        left = groups
        if groups > 4 * shards:
            # all shards that are below a common level fill up to it; what is lost to rounding goes through the heap
            order, level, under = sorted(loads), 0.0, 0.0
            for i, load in enumerate(order):
                under += load
                level = (size + under) / (i + 1)
                if i + 1 == shards or level <= order[i + 1]:
                    break
            for i in range(shards):
                given[i] = max(0, int((level - loads[i]) // mean))
            left = groups - sum(given)
        heap = [(loads[i] + given[i] * mean, i) for i in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            load, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (load + mean, i))
        for i in range(shards):
            loads[i] += given[i] * mean
        out.append(given)
    return out


def size_class(size):
    """The size with all but its leading CLASS_BITS bits cleared."""
    spare = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, spare), spare)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    A null text is an empty one and in a group with it. Slots follow the digest, then doc_id (null first); repeated rows
    are rows of their own in one group, and rows that tie in both take slots next to each other. Very long texts count with
    all their bytes. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.table(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "rows")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = scratch.table(groups.withColumn("class", size_class(F.col("bytes"))), "groups")
    classes = sorted((tuple(r) for r in groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()), reverse=True)
    starts, at = [], 0
    for (size, n, _), given in zip(classes, schedule(classes, shards), strict=True):
        ends, sum_so_far = [], 0
        for k in given:
            sum_so_far += k
            ends.append(sum_so_far)
        starts.append((size, at, ends))
        at += n
    plan = F.broadcast(spark.createDataFrame(starts, "class long, start long, ends array<long>"))
    placed = global_rank(scratch, groups, [F.desc("class"), F.asc("digest")], "ranked_groups").join(plan, "class")
    placed = placed.withColumn("in_class", F.col("rank") - F.col("start")).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("in_class"))))
    placed = scratch.table(placed.select("digest", "n", "shard"), "placed")
    joined = split_join(rows, placed, "digest", "n", rows.count()).drop("n")
    ranked = global_rank(scratch, joined, ["shard", "digest", "doc_id"], "ranked_rows")
    before, at = [], 0
    for i, n in sorted(tuple(r) for r in placed.groupBy("shard").agg(F.sum("n")).collect()):
        before.append((i, at))
        at += n
    first = F.broadcast(spark.createDataFrame(before, "shard int, first long"))
    out = ranked.join(first, "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
