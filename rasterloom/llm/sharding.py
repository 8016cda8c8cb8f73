"""Minimax contiguous sharding: the smallest capacity into which ordered atomic groups fit.

Groups are equal texts, ordered by their 128-bit hash. The binary search runs on the
driver over a radix tree of that order: Spark sums sizes by hash prefix (at most 65,536
rows), the search brackets the smallest feasible capacity, and only the few prefixes in
which a cut may fall are refined by two more hex digits, at most 256 rows for each,
until no cut can fall inside a prefix. Capacity and cuts are then those of a greedy walk
over the groups themselves, and the driver never holds the groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage_table

FIRST_DIGITS = 4
KEY_DIGITS = 32
#: Rows a slot window sorts, most windows in a shard, and most offsets that are broadcast (beyond it they are joined by shuffle).
SLOT_ROWS, MOST_BUCKETS, MOST_OFFSETS = 50_000, 4096, 100_000


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, group key, size (UTF-8 bytes + 1) and CRC-32 of each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.md5(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))


class _Node:
    """A hash prefix, its size, and whether it is one group."""

    __slots__ = ("atomic", "prefix", "size")

    def __init__(self, prefix: str, size: int, atomic: bool):
        self.prefix, self.size, self.atomic = prefix, size, atomic


def _fill(nodes: list[_Node], capacity: int, poured: bool, most: int) -> list[tuple[int, int]] | None:
    """(index of the node, place in it) where each shard starts, greedily; None if ``most`` shards don't hold all.

    poured: a prefix of several groups may be cut anywhere (a lower bound); else nowhere (an upper bound).
    """
    starts, room = [(0, 0)], capacity
    for i, node in enumerate(nodes):
        if node.size <= room:
            room -= node.size
            continue
        if poured and not node.atomic:
            left, at = node.size - room, room
            while True:
                starts.append((i, at))
                if len(starts) > most:
                    return None
                if left <= capacity:
                    room = capacity - left
                    break
                left, at = left - capacity, at + capacity
            continue
        if node.size > capacity:
            return None
        starts.append((i, 0))
        if len(starts) > most:
            return None
        room = capacity - node.size
    return starts


def _least(nodes: list[_Node], shards: int, poured: bool, low: int, high: int) -> int:
    """Smallest feasible capacity by binary search; ``high`` is feasible."""
    while low < high:
        mid = (low + high) // 2
        if _fill(nodes, mid, poured, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def plan_cuts(sized: DataFrame, shards: int) -> tuple[list[str], int]:
    """Hash prefixes at which shards 1, 2, … start, each as full as whole groups allow, and the smallest capacity, exactly."""

    def summed(rows: DataFrame, digits: int) -> list[_Node]:
        by = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b"))
        return sorted((_Node(r.prefix, int(r.size), r.a == r.b) for r in by.collect()), key=lambda n: n.prefix)

    nodes = summed(sized, FIRST_DIGITS)
    total = sum(n.size for n in nodes)
    while True:
        floor = max([-(-total // shards), 1, *(n.size for n in nodes if n.atomic)])
        low = _least(nodes, shards, True, floor, max(total, 1))
        high = _least(nodes, shards, False, low, max(total, 1))
        fine = _open(nodes, low, high, shards)
        if not fine:  # the brackets have met too, as no cut between them divides a prefix
            return [nodes[i].prefix for i, _ in _fill(nodes, high, False, shards)[1:]], high
        had = min(len(n.prefix) for n in fine)
        these = {n.prefix for n in fine if len(n.prefix) == had}
        finer = summed(sized.where(F.substring("key", 1, had).isin(sorted(these))), min(had + 2, KEY_DIGITS))
        nodes = sorted([n for n in nodes if n.prefix not in these] + finer, key=lambda n: n.prefix)


def _open(nodes: list[_Node], low: int, high: int, shards: int) -> list[_Node]:
    """Prefixes of several groups inside which a cut may fall for a capacity from ``low`` to ``high``."""
    ends, at = [], 0
    for n in nodes:
        at += n.size
        ends.append(at)
    place = lambda s: [(ends[i] - nodes[i].size) + k for i, k in s[1:]]
    first, last = _floor(nodes, ends, low, shards), place(_fill(nodes, high, True, shards))
    last += [at] * (shards - len(last))
    wanted: dict[str, _Node] = {}
    for a, b in zip(first, last, strict=False):
        i = bisect_right(ends, a)
        while i < len(nodes) and ends[i] - nodes[i].size < b:
            if not nodes[i].atomic:
                wanted[nodes[i].prefix] = nodes[i]
            i += 1
    return list(wanted.values())


def _floor(nodes: list[_Node], ends: list[int], capacity: int, shards: int) -> list[int]:
    """Earliest places of the cuts: each shard ends before the prefix that overflows it."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        i = bisect_left(ends, at + capacity + 1)
        if i >= len(nodes):
            break
        at = max(at, ends[i] - nodes[i].size)
        cuts.append(at)
    return cuts


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Equal texts share a shard; the largest shard is as small as any contiguous cut of
    the ordered groups allows. Null texts count as empty. Fewer groups than shards leave
    shards empty; an empty table gives no rows. Rows that repeat an id each get a slot,
    and rows without one the last slots of their shard.
    """
    sized = stage_table(digest(docs, id_col, text_col), "sizes")
    rows = sized.count()
    cuts, _ = plan_cuts(sized, shards) if rows else ([], 0)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    buckets = min(MOST_BUCKETS, (rows // (shards * SLOT_ROWS) + 1) * 4)
    # by a hash of the id that SQL has too, where nulls come last
    place = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    placed = sized.select("*", shard.cast("int").alias("shard"), F.coalesce(F.pmod(place, F.lit(buckets)).cast("int"), F.lit(buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("shard", "bucket").orderBy("id", "key")
    out = placed.withColumn("at", F.row_number().over(inner)).join(F.broadcast(offsets) if shards * (buckets + 1) <= MOST_OFFSETS else offsets, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
