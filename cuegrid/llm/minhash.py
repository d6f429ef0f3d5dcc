"""Near-duplicate documents by b-bit MinHash.

One pass over the texts takes the minima of 128 hash functions over each document's
five-word shingles, hashes 25 bands of five minima, and packs the low four bits of all
minima into 64 bytes. Documents that share a band are compared by counting equal packed
values, corrected for the chance that low bits agree. Within a band the candidate pairs that
connect its documents (a forest) are confirmed on the full shingle sets first, block by
block, with one document of the band in every block; only where one of them fails, or where
the blocks of a large band do not come together, are the band's other candidate pairs
between documents still apart confirmed as well. So a group of n copies costs about n
comparisons, and every candidate pair is either confirmed, refuted, or between documents
that are linked already.

Sets hold 64-bit hashes of shingles; two different shingles of a pair of documents share one
with a chance of about 1e-13 for documents of a thousand words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FEW_GROUPS, UNIT, Forest, block_pairs, changes, dealt, grouped, in_blocks, longs, overlaps, pairs, whole_groups
from .common import Workspace, chunks
from .components import connected_components
from .textscan import buffers, grams, mix, word_hashes, words

SHINGLE = 5
MINIMA, BITS, BANDS, BAND_ROWS = 128, 4, 25, 5
#: Estimates from so many standard errors below the similarity looked for go on to confirmation.
MARGIN = 4.5
#: Rows of a block when comparing signatures, and of one when all blocks are paired; rows and
#: shingles compared at once when confirming.
SIGNATURE_BLOCK, PAIRED_BLOCK, SET_BLOCK, SET_WEIGHT = 128, 256, 64, 200_000

_random = np.random.default_rng(20240229)
FACTOR = _random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSET = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
FOLDED = np.frombuffer(_FOLD, np.uint8)


def shingle_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order and each row's bounds; a row of 1 to 4 words has one, its whole sequence."""
    n = np.diff(first)
    g = grams(h, SHINGLE)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(bounds[-1]), np.uint64)
    long = n >= SHINGLE
    c = count[long]
    if len(c):
        within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        out[np.repeat(bounds[:-1][long], c) + within] = g[np.repeat(first[:-1][long], c) + within]
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = h[first[r] : first[r + 1]]
        out[bounds[r]] = mix(grams(own, len(own)) + np.uint64(len(own)))[0]
    return out, bounds


def signatures(s: np.ndarray, bounds: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Minima (rows x MINIMA, uint32) of non-empty rows of shingle hashes."""
    rows = len(bounds) - 1
    out = np.empty((rows, MINIMA), np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, side="right")) - 1)
        part, at = x[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        for k in range(MINIMA):
            v = part * FACTOR[k] + OFFSET[k]
            v ^= v >> np.uint32(15)
            out[lo:hi, k] = np.minimum.reduceat(v, at)
        lo = hi
    return out


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words (rows x MINIMA * BITS / 64)."""
    per = 64 // BITS
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), -1, per)
    shift = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shift, axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed rows: share of equal values, corrected for chance agreement."""
    d = a ^ b
    for k in range(1, BITS):
        d = d | ((a ^ b) >> np.uint64(k))
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    equal = MINIMA - np.bitwise_count(d & mask).sum(axis=1)
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate from which pairs of that similarity are confirmed; about 0.70 for 85, 0.63 for 80."""
    chance, s = 1 / (1 << BITS), percent / 100
    p = chance + (1 - chance) * s
    return s - MARGIN * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (rows x BANDS), different bands apart."""
    v = minima[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(len(minima), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), v.shape[:2])
    for k in range(BAND_ROWS):
        key = mix(key ^ v[:, :, k])
    return key


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = buffers(column)
    return FOLDED[data], bounds


def sketch(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest of the normal word sequence, packed signature, band keys, and the columns ``keep``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, bounds = _folded(part.column(1))
            starts, ends, first = words(data, bounds)
            s, at = shingle_hashes(word_hashes(data, starts, ends), first)
            filled = np.flatnonzero(np.diff(at) > 0)
            n, digest = np.zeros(part.num_rows, np.int64), [None] * part.num_rows
            packed, keys = [None] * part.num_rows, [None] * part.num_rows
            if len(filled):
                minima = signatures(s, np.append(at[:-1][filled], at[-1]))
                bits, bands = pack_bits(minima), band_keys(minima).view(np.int64)
                for k, r in enumerate(filled):
                    n[r] = len(np.unique(s[at[r] : at[r + 1]]))
                    text = data[bounds[r] : bounds[r + 1]].tobytes()
                    digest[r] = hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()
                    packed[r], keys[r] = bits[k].tobytes(), bands[k]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *part.columns[2:]],
                ["doc_id", "n_shingles", "digest", "packed", "bands", *keep],
            )

    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, packed binary, bands array<long>{more}")


def _bits(group: pa.RecordBatch) -> np.ndarray:
    column = group.column(group.schema.get_field_index("packed"))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(group.num_rows, -1)


def _chunked(weight: np.ndarray, most: int) -> np.ndarray:
    """Numbers of consecutive chunks of at most ``most`` rows and about SET_WEIGHT in total."""
    by_weight = (np.cumsum(weight) - weight) // SET_WEIGHT
    return np.cumsum(np.append(0, np.diff(np.arange(len(weight)) // most + by_weight) > 0))[: len(weight)]


def _unit_numbers(key: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of parts, apart between units and seeded by the band key."""
    out = key.view(np.uint64)
    for p in parts:
        out = mix(out ^ (p.astype(np.uint64) + np.uint64(1)))
    return out.view(np.int64)


def alike(units: DataFrame, least: float, most: int = SET_BLOCK) -> DataFrame:
    """For each band unit candidate pairs (a < b, estimate ``least`` or more) that connect all it could connect.

    ``unit`` numbers a set of pairs of one unit with the same a, small enough to compare at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", *UNIT]):
            key, bi, bj, own, node, n = longs(group, "key", *UNIT, "_own", "node", "n")
            order = np.lexsort((node, bj, bi, key))  # roots are least nodes, whatever the order of rows
            key, bi, bj, own, node, n = (x[order] for x in (key, bi, bj, own, node, n))
            bits, tree = _bits(group)[order], Forest(len(node))
            for i, j in pairs(changes(key, bi, bj), len(node), own, bi, bj, 1 << 17):
                good = estimate(bits[i], bits[j]) >= least
                tree.add(i[good], j[good])
            i, j = tree.links()
            apart = node[i] != node[j]
            i, j = i[apart], j[apart]
            by_root = np.lexsort((j, i))
            i, j = i[by_root], j[by_root]
            chunk = np.zeros(len(i), np.int64)
            heads = changes(i)
            for lo, hi in zip(heads, np.append(heads[1:], len(i)), strict=False):  # no heads without links
                chunk[lo:hi] = _chunked(n[j[lo:hi]], most)
            unit = _unit_numbers(key[i], bi[i], bj[i], node[i], chunk)
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(node[i]), pa.array(node[j]), pa.array(unit)], ["key", "a", "b", "unit"])

    return dealt(units, "key", *UNIT).mapInArrow(run, "key long, a long, b long, unit long")


def crossing(units: DataFrame, least: float, most: int = SET_BLOCK) -> DataFrame:
    """(unit, node) for what is left to compare: candidate pairs of nodes in different components.

    A pair is looked at in the first band that both have in common. Rows of a unit are put
    side by side by component and cut into chunks; two chunks with such a pair give a unit
    that holds the nodes of these pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", *UNIT]):
            key, bi, bj, own, node, n, home = longs(group, "key", *UNIT, "_own", "node", "n", "component")
            bits = _bits(group)
            bands = group.column(group.schema.get_field_index("bands")).flatten().to_numpy().reshape(group.num_rows, BANDS)
            starts = changes(key, bi, bj)
            chunk = np.zeros(len(node), np.int64)
            for lo, hi in zip(starts, np.append(starts[1:], len(node)), strict=True):
                order = lo + np.lexsort((node[lo:hi], home[lo:hi]))
                chunk[order] = _chunked(n[order], most)
            names, members = [], []
            for i, j in pairs(starts, len(node), own, bi, bj, 1 << 16):
                left = home[i] != home[j]
                i, j = i[left], j[left]
                good = estimate(bits[i], bits[j]) >= least
                i, j = i[good], j[good]
                same = bands[i] == bands[j]
                first = (bands[i, same.argmax(axis=1)] == key[i]) | ~same.any(axis=1)
                i, j = i[first], j[first]
                unit = _unit_numbers(key[i], bi[i], bj[i], np.minimum(chunk[i], chunk[j]), np.maximum(chunk[i], chunk[j]))
                names += [unit, unit]
                members += [node[i], node[j]]
            if names:
                both = np.unique(np.stack([np.concatenate(names), np.concatenate(members)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["unit", "node"])

    return dealt(units, "key", *UNIT).mapInArrow(run, "unit long, node long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, n and the sorted distinct shingle hashes of each row (text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, bounds = _folded(part.column(1))
            starts, ends, first = words(data, bounds)
            s, at = shingle_hashes(word_hashes(data, starts, ends), first)
            sets = [np.unique(s[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["node", "n", "members"],
            )

    return docs.select("node", "text").mapInArrow(run, "node long, n long, members binary")


def _sizes_of_two(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of sets 0 and 1, 2 and 3, and so on."""
    value = np.concatenate(sets)
    pair = np.repeat(np.arange(len(sets)) // 2, [len(x) for x in sets])
    order = np.lexsort((value, pair))
    value, pair = value[order], pair[order]
    twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=len(sets) // 2)


def confirmed(units: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect what the true links connect within each unit, on full sets: 100 * intersection >= percent * union.

    Rows (unit, node, n, members, component); nodes of one component are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["unit"], "members"):
            unit, node, n, home = longs(group, "unit", "node", "n", "component")
            raw = group.column(group.schema.get_field_index("members"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
            starts = changes(unit)
            size = np.diff(np.append(starts, len(node)))
            tree = Forest(len(node))
            two = starts[size == 2]
            if len(two):
                both = _sizes_of_two([sets[k] for s in two for k in (s, s + 1)])
                good = 100 * both >= percent * (n[two] + n[two + 1] - both)
                tree.add(two[good], two[good] + 1)
            for lo, rows in zip(starts[size > 2], size[size > 2], strict=True):
                hi = lo + rows
                both = overlaps(sets[lo:hi])
                union = n[lo:hi, None] + n[None, lo:hi] - both
                good = (100 * both >= percent * union) & (home[lo:hi, None] != home[None, lo:hi])
                i, j = np.nonzero(np.triu(good, 1))
                tree.add(i + lo, j + lo)
            i, j = tree.links()
            apart = node[i] != node[j]
            yield pa.RecordBatch.from_arrays([pa.array(node[i[apart]]), pa.array(node[j[apart]])], ["a", "b"])

    return dealt(units, "unit").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links from ``percent`` similarity on.

    Null or empty text, or text without words: n_shingles 0, a component of its own, kept.
    Null doc_id: linked with nothing, component null, kept. Rows that share a doc_id count
    as one document; repeated rows get equal results. Empty table: no rows. Other columns
    are ignored but for those in ``keep``, which come along (a caller can so tell rows of
    one doc_id apart). Texts of any length are handled whole.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    rows = ws.save(sketch(docs, keep), "sketch")
    known = rows.where("digest is not null and doc_id is not null")
    # one representative per distinct word sequence; copies need no comparison
    classes = ws.save(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("packed").alias("packed"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    marks = ws.save(classes.groupBy("node").agg(F.first("packed").alias("packed"), F.first("bands").alias("bands"), F.max("n").alias("n")), "marks")
    postings = classes.select("node", F.explode("bands").alias("key")).distinct()
    bands, groups = grouped(ws, postings, "key", "node", SIGNATURE_BLOCK, "sizes")
    bands = ws.save(bands, "bands")
    least = least_estimate(percent)
    edges = ws.save(alike(in_blocks(bands, groups, "key", "node").join(marks.drop("bands"), "node"), least, SET_BLOCK), "edges")
    # pairs that several bands propose are compared once
    tried = ws.save(edges.groupBy("a", "b").agg(F.min("unit").alias("unit")), "tried")
    asked = ws.save(tried.select("unit", F.col("a").alias("node")).union(tried.select("unit", "b")).distinct(), "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(asked.select("node").distinct(), "node")
    sets = ws.save(shingle_sets(texts), "sets")
    links = ws.save(confirmed(asked.join(sets, "node").withColumn("component", F.col("node")), percent), "links")
    homes = ws.save(connected_components(ws, links, "linked"), "homes")
    # bands with a refuted pair and others besides it, and those of several blocks that are not one component
    home = lambda end: homes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_home"))
    refuted = tried.join(home("a"), "a", "left").join(home("b"), "b", "left").where("coalesce(a_home, a) <> coalesce(b_home, b)").select("a", "b")
    refuted = ws.save(refuted, "refuted")
    large = bands.where("_blocks > 1").join(homes, "node", "left").groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("low"), F.max(F.coalesce("component", "node")).alias("high"))
    still = ws.save(edges.join(refuted, ["a", "b"]).select("key").union(large.where("low <> high").select("key")).distinct(), "open")
    left = bands.where("_n > 2").join(F.broadcast(still) if still.count() <= FEW_GROUPS else still, "key").withColumn("_blocks", F.ceil(F.col("_n") / PAIRED_BLOCK))
    seen = marks.join(homes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    again = ws.save(crossing(block_pairs(left, "node").join(seen, "node"), least, SET_BLOCK), "again")
    late = again.join(sets, "node").join(homes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    late = ws.save(confirmed(late, percent), "late")
    if not late.isEmpty():
        homes = connected_components(ws, links.unionByName(late), "all")
    homes = classes.select("digest", "node").join(homes, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    homes = ws.save(homes, "components")
    out = rows.select("doc_id", "n_shingles", *keep, F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(homes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *keep)
    return ws.result(out)
