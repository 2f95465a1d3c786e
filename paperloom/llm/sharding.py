"""Sharding by Karmarkar-Karp differencing: the partial partitions with the largest spread are combined, oppositely
ordered, again and again, which balances bytes tightly though groups of equal texts stay whole."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut, read, salted_join

SHARDS = 16
NODE_GROUPS = 20_000  # groups of equal texts that one task partitions, about
FAN = 256  # partial partitions of tasks that one task combines on the next level
SLOT_ROWS = 2_000  # rows of a stretch of slots, about


def differencing(parts: list[list[tuple[int, int]]], k: int) -> np.ndarray:
    """``parts``: partial partitions, each at most k pairs (sum, leaf). The lane, 0 to k - 1, of each leaf.

    A single item is a partial partition of one pair. Leaves are numbered from 0 without gaps."""
    heap, n = [], 0
    for i, p in enumerate(parts):
        own = sorted(((s, leaf) for s, leaf in p), key=lambda x: (-x[0], x[1]))
        own = [(s, (leaf,)) for s, leaf in own] + [(0, None)] * (k - len(own))
        n += len(p)
        heap.append((own[-1][0] - own[0][0], i, own))
    heapq.heapify(heap)
    count = len(parts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [
            (x + y, p if q is None else q if p is None else (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)
        ]
        both.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], count, both))
        count += 1
    lanes = np.zeros(n, np.int64)
    for lane, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree] if tree is not None else []
        while stack:
            t = stack.pop()
            if len(t) == 1:
                lanes[t[0]] = lane
            else:
                stack += t
    return lanes


def partition_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(g1, g2, shard) of each group (g1, g2, bytes).

    Each task partitions the groups that a hash gives it; tasks' partial partitions are then combined, FAN at a time,
    level by level, by the same differencing: no task sees more than its share, the driver sees only counts."""
    nodes = max(1, -(-groups.count() // NODE_GROUPS))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True], ignore_index=True)
        lane = differencing([[(int(b), i)] for i, b in enumerate(pdf["bytes"])], shards)
        return pdf.assign(lane=lane)[["node", "g1", "g2", "bytes", "lane"]]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "lane"], ignore_index=True)
        parts: dict[int, list[tuple[int, int]]] = {}
        for i, (n, b) in enumerate(zip(pdf["node"], pdf["bytes"], strict=True)):
            parts.setdefault(int(n), []).append((int(b), i))
        return pdf.assign(up=differencing(list(parts.values()), shards))[["parent", "node", "lane", "bytes", "up"]]

    dealt = groups.withColumn("node", F.pmod(F.xxhash64("g1", "g2"), F.lit(nodes)))
    at = cut(dealt.groupBy("node").applyInPandas(leaves, "node long, g1 long, g2 long, bytes long, lane long"))
    sums = at.groupBy("node", "lane").agg(F.sum("bytes").alias("bytes"))
    while nodes > 1:
        nodes = -(-nodes // FAN)
        up = sums.withColumn("parent", F.floor(F.col("node") / FAN))
        up = cut(up.groupBy("parent").applyInPandas(joined, "parent long, node long, lane long, bytes long, up long"))
        at = salted_join(at, up.drop("bytes"), ["node", "lane"], ["g1"], salts=4)
        at = at.select(F.col("parent").alias("node"), "g1", "g2", "bytes", F.col("up").alias("lane"))
        sums = up.groupBy(F.col("parent").alias("node"), F.col("up").alias("lane")).agg(F.sum("bytes").alias("bytes"))
    return at.select("g1", "g2", F.col("lane").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs``: byte sums of shards are near equal.

    Equal texts share a shard (null counts as empty), however many: a group with more than its share of all bytes makes
    its shard larger, and the others still balance. Slots count from 0 in each shard without gaps, by a hash of doc_id
    and text, then doc_id; repeated rows each have a slot of their own. Null ids and empty texts take part; an empty table gives an
    empty one; other columns take no part. The size of a text is its UTF-8 bytes and one.

    Only ids, sizes and hashes are shuffled. A text of a third of all rows is one partial sum a task, its rows are dealt
    over salts in the join, and slots are numbered in stretches of about SLOT_ROWS rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(9), text).alias("g2"),
    )
    rows = cut(rows)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    at = partition_groups(cut(groups), shards)
    stretches = max(1, -(-rows.count() // SLOT_ROWS))
    key = F.xxhash64("doc_id", "g1", "g2")  # null ids are dealt by their texts
    dealt = salted_join(rows, at, ["g1", "g2"], ["doc_id", "size"]).withColumn("st", F.pmod(key, F.lit(stretches)))
    dealt = cut(dealt)
    counts = dealt.groupBy("shard", "st").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("st").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "st", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "st").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "g1", "g2")
    numbered = dealt.withColumn("rn", F.row_number().over(own) - 1).join(offsets, ["shard", "st"])
    slot = (F.col("offset") + F.col("rn")).cast("long").alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", slot)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all rows of ``docs`` as Parquet in a folder for each shard, the one that assign_shards() gives their texts: null
    and repeated ids keep all their rows, null texts count as empty, a column called shard is replaced, an empty table
    writes no folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("shard").withColumns({"__pl_g1": F.xxhash64(text), "__pl_g2": F.xxhash64(F.lit(9), text)})
    groups = rows.groupBy(F.col("__pl_g1").alias("g1"), F.col("__pl_g2").alias("g2"))
    at = partition_groups(cut(groups.agg(F.sum(F.octet_length(text) + 1).alias("bytes"))), shards)
    at = at.select(F.col("g1").alias("__pl_g1"), F.col("g2").alias("__pl_g2"), "shard")
    rows = rows.withColumn("__pl_u", F.monotonically_increasing_id())
    out = salted_join(rows, at, ["__pl_g1", "__pl_g2"], ["__pl_u"]).drop("__pl_g1", "__pl_g2", "__pl_u")
    out.write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard by the law ``bytes``, and its slot there; nulls and repeats as assign_shards() says."""
    out = assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
