"""A Merkle manifest of a dataset, with ranks from digit histograms and a trie of ranks.

A document's rank in its group (its source) comes from histograms of the digits of its id,
coarse to fine: the numbers of documents in earlier cells of each level add up, and only a
small last cell is sorted. No step orders the whole table. The rank's digits in base
``fanout`` then key the nodes of the tree: nodes that share all but their last digits meet
in one bounded cell, which is reduced several levels at once, longest prefixes first. The
subroots of the groups are the leaves of the same reduction, ordered by group.

A path is text: for every level the digests left of the node, a dot, those right of it,
and a semicolon.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import changes, longs, whole_groups
from .common import Workspace, ranked

#: Bits of a digit, documents of a last cell, and levels of the tree that one visit reduces.
DIGIT, CELL, LEVELS = 8, 512, 8


def spelled(column: str | Column) -> Column:
    """A value as it enters a leaf: UTF-8 bytes, a colon and the value, or a dash for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*map(spelled, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    side = lambda level, i: F.element_at(F.split(level, r"\."), i)
    levels = F.filter(F.split(path, ";"), lambda x: x != "")
    return F.aggregate(levels, leaf, lambda digest, level: F.sha2(F.concat(side(level, 1), digest, side(level, 2)), 256))


def _digits(leaves: DataFrame) -> list[Column]:
    """Digits of a row's place among all: those of its id in which ids differ, then of its leaf, then of its row."""
    sign = F.lit(-(1 << 63)).cast("long")
    key = F.col("doc_id").cast("long").bitwiseXOR(sign)
    low, high = leaves.agg(F.min("doc_id"), F.max("doc_id")).first()
    bits = ((low + (1 << 63)) ^ (high + (1 << 63))).bit_length() if low is not None else 0
    mask = (1 << DIGIT) - 1

    def digit(x: Column, shift: int) -> Column:
        return F.coalesce(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).cast("int"), F.lit(-1))

    ids = [digit(key, DIGIT * k) for k in reversed(range(max(1, -(-bits // DIGIT))))]
    of_leaf = [F.conv(F.substring("leaf", 3 * k + 1, 3), 16, 10).cast("int") for k in range(2)]
    return ids + of_leaf + [digit(F.col("_row"), DIGIT * k) for k in reversed(range(-(-64 // DIGIT)))]


def ranks(ws: Workspace, leaves: DataFrame, cell: int = CELL) -> DataFrame:
    """Leaves (group, doc_id, leaf, _row, ...) with ``r``, the rank in the group from 0 by doc_id, nulls first, then leaf.

    The finest histogram has just so many digits that no cell holds more than ``cell`` rows.
    """
    total = leaves.count()
    digits = _digits(leaves)
    names = [f"_d{k}" for k in range(1, len(digits) + 1)]
    coded = leaves.select("*", *[d.alias(n) for n, d in zip(names, digits, strict=True)])
    depth = 1
    while depth < len(digits) and total > cell << (DIGIT * depth - 1):
        depth += 1
    while True:
        key = ["group", *names[:depth]]
        finest = ws.save(coded.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), f"cells{depth}")
        if depth == len(digits) or (finest.agg(F.max("_n")).first()[0] or 0) <= cell:
            break
        depth += 1
    # coarse to fine: what lies before a cell is what lies before its parent, and its elder siblings
    before = None
    for k in range(1, depth + 1):
        own = finest if k == depth else finest.groupBy("group", *names[:k]).agg(F.sum("_n").alias("_n"))
        parent = ["group", *names[: k - 1]]
        elder = Window.partitionBy(*parent).orderBy(names[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        own = own.select(*parent, names[k - 1], F.coalesce(F.sum("_n").over(elder), F.lit(0)).alias("_elder"))
        if before is not None:
            own = own.join(before, parent).withColumn("_elder", F.col("_elder") + F.col("_before")).drop("_before")
        before = own.withColumnRenamed("_elder", "_before")
    inside = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_first(), "leaf", "_row")
    found = coded.join(before, key).withColumn("r", F.col("_before") + F.row_number().over(inside) - 1)
    return found.drop(*names, "_before")


def _depth(n: int, fanout: int) -> int:
    k = 0
    while fanout**k < n:
        k += 1
    return k


def reduce_cells(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (group, n, r, digest) with ``path`` to the node above their cell, and that node's digest, ``top``.

    ``n`` is the number of the group's nodes. A cell are the nodes whose rank shares all
    digits but the last ``levels``. A group that is one node already stays as it is.
    """
    size = fanout**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["group", "cell"], "digest"):
            starts = [*changes(*longs(batch, "group", "cell")).tolist(), batch.num_rows]
            digests, n = batch.column("digest").to_pylist(), batch.column("n").to_numpy()
            paths: list[str] = []
            tops: list[str] = []
            for a, b in zip(starts, starts[1:], strict=False):
                now, own = digests[a:b], [""] * (b - a)
                for k in range(min(levels, _depth(int(n[a]), fanout))):
                    runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
                    sides = [f"{''.join(x[:i])}.{''.join(x[i + 1 :])};" for x in runs for i in range(len(x))]
                    span = fanout**k
                    own = [p + sides[i // span] for i, p in enumerate(own)]
                    now = [hashlib.sha256("".join(x).encode()).hexdigest() for x in runs]
                paths.extend(own)
                tops.extend(now * (b - a))  # a cell ends as one node
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("n"), batch.column("r"), pa.array(paths, pa.string()), pa.array(tops, pa.string())], ["group", "n", "r", "path", "top"])

    celled = nodes.select("group", F.floor(F.col("r") / size).cast("long").alias("cell"), "n", "r", "digest")
    together = celled.repartition("group", "cell").sortWithinPartitions("group", "cell", "r")
    return together.mapInArrow(run, "group long, n long, r long, path string, top string")


def trees(ws: Workspace, nodes: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Nodes (group, n, r, digest) as (group, r, path, top) with the whole path to the root ``top`` of the group's tree."""
    size, visits = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        visits.append(ws.save(reduce_cells(nodes, fanout, levels), f"{name}{len(visits)}"))
        most = -(-most // size)
        if most <= 1:
            break
        cell = F.floor(F.col("r") / size).cast("long")
        nodes = visits[-1].where(F.col("r") % size == 0).select("group", F.ceil(F.col("n") / size).alias("n"), cell.alias("r"), F.col("top").alias("digest"))
    above = visits.pop().select("group", "r", "path", "top")
    while visits:
        upper = above.select("group", F.col("r").alias("_cell"), F.col("path").alias("_above"), F.col("top").alias("_top"))
        below = visits.pop().withColumn("_cell", F.floor(F.col("r") / size).cast("long"))
        above = below.join(upper, ["group", "_cell"]).select("group", "r", F.concat("path", "_above").alias("path"), F.col("_top").alias("top"))
    return above


def manifest(docs: DataFrame, fields: list[str], received: list[str | Column] | None = None, fanout: int = 3, levels: int = LEVELS, cell: int = CELL) -> DataFrame:
    """doc_id, source, leaf, received (the leaf of the values ``received``), rank, subroot, root and path of every row.

    A leaf is the hash of ``fields``. Null source: a group of its own, the first. Null
    doc_id: first in its source; rows of one doc_id by leaf, equal rows side by side, each
    a leaf of its own. Null values, empty and very long texts have their own spellings.
    Empty table: no rows. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "merkle")
    leaves = docs.select("doc_id", "source", leaf_of(*fields).alias("leaf"), leaf_of(*(received or fields)).alias("received"))
    leaves = ws.save(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    counts = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    groups = ws.save(ranked(ws, counts, [F.col("source").asc_nulls_first()], {}, "sources").withColumnRenamed("rn", "group"), "groups")
    named = groups.select("group", "n", F.col("source").alias("_name"))
    keyed = ws.save(leaves.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name"), "keyed")
    placed = ws.save(ranks(ws, keyed, cell), "placed")
    inner = trees(ws, placed.select("group", "n", "r", F.col("leaf").alias("digest")), fanout, levels, "tree")
    inner = ws.save(inner, "inner")
    n = groups.count()
    subroots = inner.where("r = 0").select(F.lit(0).cast("long").alias("group"), F.lit(n).cast("long").alias("n"), F.col("group").alias("r"), F.col("top").alias("digest"))
    outer = trees(ws, subroots, fanout, levels, "roots").select(F.col("r").alias("group"), F.col("path").alias("_outer"), F.col("top").alias("root"))
    inner = inner.withColumnRenamed("path", "_inner").withColumnRenamed("top", "subroot")
    out = placed.join(inner, ["group", "r"]).join(outer, "group")
    return out.select("doc_id", "source", "leaf", "received", F.col("r").alias("rank"), "subroot", "root", F.concat("_inner", "_outer").alias("path"))
