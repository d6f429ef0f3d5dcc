"""Minimax contiguous sharding with DataFrame operations only.

Documents with equal text form an atomic group; groups are ordered by their least doc_id.
The least capacity for which a greedy walk needs no more than ``shards`` shards is found
by binary search, and the shards are cut there. Prefix sums are distributed (ranges of the
order, then offsets); the walk reads a summary of bounded size that is refined only around
the possible cuts, so neither the driver nor a task ever holds all groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, ranked

#: Most cells of prefix sums that one refinement sends to the driver (three longs each).
CELLS = 1 << 15


class _Cells:
    """For each non-empty cell of prefix sums its least and greatest sum, in order."""

    def __init__(self, rows: list[tuple[int, int]], total: int):
        self.low = [a for a, _ in rows]
        self.high = [b for _, b in rows]
        self.total = total

    def reach(self, at: int, sure: bool) -> int:
        """The greatest prefix sum <= ``at``: a lower bound if ``sure``, else an upper bound."""
        i = bisect_right(self.low, at) - 1
        if i < 0:
            return 0
        return self.high[i] if self.high[i] <= at else (self.low[i] if sure else at)

    def walk(self, capacity: int, shards: int, sure: bool) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.reach(cuts[-1] + capacity, sure))
        return cuts

    def least(self, lo: int, hi: int, shards: int, sure: bool) -> int:
        """The least capacity in [lo, hi] whose walk ends at the total; hi if none below does."""
        while lo < hi:
            mid = (lo + hi) // 2
            if self.walk(mid, shards, sure)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def minimax_cuts(points: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards as prefix sums; ``points`` holds every group's prefix sum in ``p``."""
    lo, hi = max(-(-total // shards), largest), min(total, -(-total // shards) + largest)
    spans = [(0, total)]
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in spans) // CELLS))
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("p").between(a, b)
        found = points.where(inside).groupBy(F.floor(F.col("p") / width).alias("cell")).agg(F.min("p"), F.max("p"))
        rows = sorted((r[1], r[2]) for r in found.collect())  # at most CELLS + shards rows
        cells = _Cells(rows, total)
        low, high = cells.least(lo, hi, shards, False), cells.least(lo, hi, shards, True)
        if low == high or width == 1:
            return cells.walk(high, shards, True)[1:]
        lo, hi = low, high
        first, last = cells.walk(lo, shards, True), cells.walk(hi, shards, False)
        # the cuts for any capacity between lo and hi lie in these spans, and so does the cell below each
        wide = [(max(0, a - width), min(total, b)) for a, b in zip(first[1:], last[1:], strict=True)]
        spans = []
        for a, b in sorted(wide):
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))


def minimax_shards(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Size is the text's UTF-8 bytes plus ``overhead``; null text has no bytes and groups with
    null only. Slots count from 0 in each shard, copies of a text side by side. Null doc_id:
    ordered first in its group. Repeated rows: each has a slot. Empty table: no rows. Fewer
    groups than shards: the last shards stay empty. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.col("text")
    rows = ws.save(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("_key"),
        ),
        "rows",
    )
    groups = ws.save(rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes")), "groups")
    total, largest = groups.agg(F.sum("_bytes"), F.max("_bytes")).first()
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    order = [F.col("_first"), F.col("_key"), F.col("doc_id"), F.col("text_crc32")]
    placed = ws.save(ranked(ws, rows.join(groups.drop("_bytes"), "_key"), order, {"end": "size"}, "dealt"), "placed")
    points = ws.save(placed.groupBy("_key").agg(F.max("end").alias("p")).select("p"), "points")
    cuts = minimax_cuts(points, total, largest, shards)
    # a row lies in the first shard whose end is not before the row's own end
    shard = F.lit(0)
    for c in sorted(set(cuts))[:-1]:
        shard = shard + F.when(F.col("end") > c, 1).otherwise(0)
    placed = placed.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("rn").alias("_rn0"))
    out = placed.join(F.broadcast(starts), "shard")  # a row per shard
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("rn") - F.col("_rn0")).alias("slot"))
