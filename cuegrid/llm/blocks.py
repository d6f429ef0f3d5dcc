"""Comparing the members of groups of any size: blocks, pairs of blocks, bounded tasks.

A group of n rows is cut by hash into blocks. A block by itself, or every pair of blocks,
is one unit of work with at most twice a block's rows, so a hot group spreads over many
tasks and no pair of rows is ever a row of a table: a unit returns the forest of its links,
or counts per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UNIT = ["_bi", "_bj"]
#: A table of so many keys with two numbers each, a few megabytes, may be broadcast.
FEW_GROUPS = 200_000


def grouped(ws: Workspace, rows: DataFrame, key: str, member: str, block_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of groups with two members or more, with ``_n``, their group's size, and ``_blocks``, its blocks; and the groups with their least member, ``_hub``.

    Sizes are counted and written first. Few of them are broadcast; otherwise both sides of
    the join come from exchanges of their own, so that Spark can split the rows of a hot key.
    """
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(member).alias("_hub")).where("_n > 1")
    groups = ws.save(groups.withColumn("_blocks", F.ceil(F.col("_n") / block_rows)), name)
    sizes = groups.drop("_hub")
    return rows.join(F.broadcast(sizes) if groups.count() <= FEW_GROUPS else sizes, key), groups


def in_blocks(rows: DataFrame, groups: DataFrame, key: str, member: str) -> DataFrame:
    """Rows (key, member) of ``grouped``, each once, in its own block; a group's least member stands in all of its blocks.

    Columns as of ``block_pairs``. Members alike to the least one meet in linear time.
    """
    own = rows.select(key, member, F.pmod(F.xxhash64(member, F.lit(1)), F.col("_blocks")).alias("_own"))
    hubs = groups.where("_blocks > 1").select(key, F.col("_hub").alias(member), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_own"))
    return own.unionByName(hubs).withColumn("_bi", F.col("_own")).withColumn("_bj", F.col("_own"))


def block_pairs(rows: DataFrame, member: str) -> DataFrame:
    """Rows of ``grouped``, once for each pair of blocks they take part in.

    Adds _bi <= _bj, the unit within the group, and _own, the row's block.
    """
    keep = [c for c in rows.columns if c not in ("_n", "_blocks")]
    cut = rows.withColumn("_own", F.pmod(F.xxhash64(member, F.lit(1)), F.col("_blocks")))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return cut.select(*keep, "_own", F.least("_own", "_other").alias("_bi"), F.greatest("_own", "_other").alias("_bj"))


def dealt(units: DataFrame, *by: str) -> DataFrame:
    """Units brought together and sorted, for ``whole_groups``."""
    return units.repartition(*by).sortWithinPartitions(*by)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], bytes_column: str | None = None, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of whole units from batches sorted ``by`` their long columns, with bounded payload or a single unit."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        starts = changes(*longs(batch, *by))
        if len(starts) > 1:
            yield from _slices(batch.slice(0, int(starts[-1])), starts, bytes_column, most_bytes)
            held = batch.slice(int(starts[-1]))
        else:
            held = batch if batch.num_rows else None
    if held is not None:
        yield held


def _slices(batch: pa.RecordBatch, starts: np.ndarray, column: str | None, most: int) -> Iterator[pa.RecordBatch]:
    if column is None:
        yield batch
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    lo = 0
    for a, b in zip(starts, [*starts[1:-1], batch.num_rows], strict=False):
        if a > lo and total[b] - total[lo] > most:
            yield batch.slice(int(lo), int(a - lo))
            lo = a
    if batch.num_rows > lo:
        yield batch.slice(int(lo))


def pairs(starts: np.ndarray, n: int, own: np.ndarray, bi: np.ndarray, bj: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) that each unit has to compare, some hundred thousand at a time.

    Within a diagonal unit all pairs; in any other those of different blocks.
    """
    if not n:
        return
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    count = ends - 1 - np.arange(n)
    total = np.cumsum(count)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
        keep = (bi[i] == bj[i]) | (own[i] != own[j])
        yield i[keep], j[keep]
        lo = hi


class Forest:
    """Connects n rows by the links given, and keeps those links that connect what was apart.

    ``label`` is the least row that each row reaches.
    """

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]  # roots
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[changes(high[order])]  # each higher root is hung on one lower root: no circles
            self.kept.append((i[first], j[first]))
            self.label[high[first]] = low[first]
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *[k[s] for k in self.kept]]) for s in (0, 1))


def overlaps(sets: list[np.ndarray], step: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections; columns that only one set has are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = changes(value)
    size = np.diff(np.append(starts, len(value)))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += (m @ m.T).astype(np.int64)  # whole numbers up to step, exact in single precision
    return out
