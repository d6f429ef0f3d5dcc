"""Packing tokenised documents into sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the plan works on their histogram, which
is bounded by the capacity whatever the corpus holds. Large lengths are sorted and split
into groups of equal cardinality whose members are rounded up to the group's greatest;
configurations of these few sizes are chosen to fill a sequence best; the actual documents
then stand in for the rounded ones; small documents go best-fit into what is left. The
plan says which ranks of each length go where, and every piece finds its place by a join.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, chunks, ranked

#: Groups of large lengths, and the share of the capacity up to which a length is small.
GROUPS, SMALL = 1024, 1 / 8

_encoders: dict[str, Callable[[str], np.ndarray]] = {}
#: Characters on whose classes all regular expression engines agree; others, and the special token, take the plain path.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-›€]|<\\|")


def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids of a byte-level vocabulary file of the ``tokenizers`` library.

    The file's vocabulary also drives an equal but faster merger (ids of byte-level
    vocabularies are merge ranks); texts with characters on which the two could split
    words differently are given to ``tokenizers`` itself. Built once per worker.
    """
    if path in _encoders:
        return _encoders[path]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @cache
    def plain() -> Tokenizer:  # large, and most texts never need it
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and token != "<|endoftext|>"}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        ids = plain().encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)
        return np.array(ids, dtype=np.uint32)

    _encoders[path] = encode
    return encode


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for part in chunks(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                got = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(got), capacity)):
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(got[s : s + n].tobytes()))
                    if with_ids:
                        ids.append(got[s : s + n].astype(np.int32))
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)


def _fill(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Indexes of sizes (with repeats) whose sum comes closest to ``room`` from below; large ones first."""
    how = np.full(room + 1, -1, np.int64)
    how[0] = len(sizes)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        frontier = reached
        for _ in range(min(n, room // s)):
            fresh = np.zeros(room + 1, bool)
            fresh[s:] = frontier[: room + 1 - s]
            fresh &= ~reached
            if not fresh.any():
                break
            how[fresh] = i
            reached = reached | fresh
            frontier = fresh
        if reached[room]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), []
    while at:
        out.append(int(how[at]))
        at -= sizes[out[-1]]
    return out


class Plan:
    """Where the ranks of each length go: rows (length, lo, hi, sequence, per, offset).

    The piece of rank lo <= r < hi among those of its length goes to sequence
    ``sequence + (r - lo) // per`` at ``offset + (r - lo) % per * length``.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL):
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences, self.capacity = 0, capacity
        self.used: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
        if histogram.get(capacity):
            self._put(capacity, histogram[capacity], self._new(histogram[capacity]), 1, 0)
        large = {n: c for n, c in histogram.items() if c and small * capacity < n < capacity}
        self._large(large, groups)
        for n in sorted((n for n, c in histogram.items() if c and n <= small * capacity), reverse=True):
            self._best_fit(n, histogram[n])

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, count: int, sequence: int, per: int, offset: int) -> None:
        lo = self.used[length]
        self.used[length] += count
        self.rows.append((length, lo, lo + count, sequence, per, offset))

    def _large(self, histogram: dict[int, int], groups: int) -> None:
        total = sum(histogram.values())
        if not total:
            return
        share = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # for each group its (length, count), long ones first
        room = share
        for n in sorted(histogram, reverse=True):
            left = histogram[n]
            while left:
                if not room:
                    members.append([])
                    room = share
                take = min(left, room)
                members[-1].append([n, take])
                left, room = left - take, room - take
        rounded: dict[int, list[list[int]]] = defaultdict(list)
        for m in members:
            rounded[m[0][0]].extend(m)  # groups with the same greatest length are one size
        sizes = sorted(rounded, reverse=True)
        counts = [sum(c for _, c in rounded[s]) for s in sizes]
        for k, s in enumerate(sizes):
            while counts[k]:
                counts[k] -= 1
                slots = [k, *(k + i for i in _fill(self.capacity - s, sizes[k:], counts[k:]))]
                counts[k] += 1
                times = min(counts[i] // slots.count(i) for i in set(slots))
                for i in slots:
                    counts[i] -= times
                self._substitute([rounded[sizes[i]] for i in slots], times)

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """Puts the groups' actual lengths into ``times`` sequences of one configuration."""
        queues = []
        for group in slots:
            queue, left = [], times
            while left:
                take = min(left, group[0][1])
                queue.append([group[0][0], take])
                group[0][1] -= take
                left -= take
                if not group[0][1]:
                    group.pop(0)
            queues.append(queue)
        while queues[0]:
            run = min(q[0][1] for q in queues)
            sequence, offset = self._new(run), 0
            for q in queues:
                self._put(q[0][0], run, sequence, 1, offset)
                offset += q[0][0]
                q[0][1] -= run
                if not q[0][1]:
                    q.pop(0)
            self._leave(self.capacity - offset, sequence, run)

    def _leave(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.open[room].append((sequence, n))

    def _best_fit(self, length: int, count: int) -> None:
        for room in sorted(r for r in self.open if r >= length):
            per = room // length
            while count and self.open[room]:
                sequence, n = self.open[room].pop()
                full = min(n, count // per)
                rest = count - full * per if full < n else 0
                rest = min(rest, per - 1)
                offset = self.capacity - room
                if full:
                    self._put(length, full * per, sequence, per, offset)
                    self._leave(room - per * length, sequence, full)
                if rest:
                    self._put(length, rest, sequence + full, rest, offset)
                    self._leave(room - rest * length, sequence + full, 1)
                self._leave(room, sequence + full + bool(rest), n - full - bool(rest))
                count -= full * per + rest
        if count:
            per = self.capacity // length
            full, rest = divmod(count, per)
            if full:
                sequence = self._new(full)
                self._put(length, full * per, sequence, per, 0)
                self._leave(self.capacity - per * length, sequence, full)
            if rest:
                sequence = self._new(1)
                self._put(length, rest, sequence, rest, 0)
                self._leave(self.capacity - rest * length, sequence, 1)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    A document is its ids followed by ``end_id``; only documents longer than ``capacity``
    are cut. Null text: just ``end_id``. Null doc_id and repeated rows: packed like any
    other row. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    pieces = ws.save(tokenize_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = Plan(histogram, capacity)
    below, seen = {}, 0
    for n in sorted(histogram):
        below[n] = seen
        seen += histogram[n]
    rows = [(n, lo + below[n], hi + below[n], s, per, at) for n, lo, hi, s, per, at in plan.rows]
    table = spark.createDataFrame(rows, "length long, _lo long, _hi long, _seq long, _per long, _off long")
    slim = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    placed = ranked(ws, slim, order, {}, "dealt")
    # the plan's size depends on the capacity alone: some thousand rows
    out = placed.join(F.broadcast(table), "length").where(F.col("rn").between(F.col("_lo"), F.col("_hi") - 1))
    k = F.col("rn") - F.col("_lo")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_seq") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_off") + k % F.col("_per") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
