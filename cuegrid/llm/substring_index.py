"""Removing repeated passages with a log-structured index of window fingerprints.

Every window of 50 words has a fingerprint: the least hash of the 16-word grams inside it.
Neighbouring windows mostly share theirs, so a document's windows fall into stretches of
equal fingerprint, and equal windows lie in stretches of equal fingerprint wherever they
occur. A run of the index holds each distinct stretch (its fingerprint and two independent
64-bit hashes of its words) and the document where it was first seen, and next to it the
distinct fingerprints. Runs are bucketed tables, written once and sorted within each
bucket; a new batch is dealt and sorted the same way, so its merge joins with the runs move
and sort nothing. A stretch seen before repeats as a whole. Where the same fingerprint has
several different stretches, their windows are taken from the texts again and compared one
by one. The batch's new stretches then become a run of their own; runs are merged into one
when there are too many. Nothing grows with the square of a passage's copies: a stretch is
kept once, and windows are compared by grouping.

Equality of windows rests on two 64-bit hashes of their words, of stretches likewise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import FEW_GROUPS
from .common import Workspace, chunks
from .textscan import buffers, grams, rolling_min, run_hashes, word_hashes, words

WINDOW, GRAM = 50, 16
#: Runs of the index before they are merged into one.
MOST_RUNS = 4
KEY = ["fp", "hi", "lo"]


class Stretches:
    """The stretches of equal fingerprint of the rows of a text column."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.data, self.bounds = buffers(column)
        self.starts, self.ends, self.first = words(self.data, self.bounds)
        self.window = window
        n = len(self.starts)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        empty = np.zeros(0, np.uint64)
        self.h = [empty, empty]
        self.start = self.end = self.row = np.zeros(0, np.int64)
        self.fp = self.hi = self.lo = empty
        if n < window:
            return
        at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        if not len(at):
            return
        self.h = [word_hashes(self.data, self.starts, self.ends, w) for w in (0, 1)]
        least = rolling_min(grams(self.h[0], gram), window - gram + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[at[1:]] != row[at[:-1]])
        head = np.flatnonzero(new)
        self.start = at[head]
        self.end = at[np.append(head[1:], len(at)) - 1] + window
        self.row, self.fp = row[self.start], least[head]
        self.hi, self.lo = (run_hashes(self.h[w], self.start, self.end, w) for w in (0, 1))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, first hash, second hash) of all windows of the chosen stretches."""
        n = self.end[chosen] - self.window + 1 - self.start[chosen]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[chosen], n)
        return at, *(run_hashes(self.h[w], at, at + self.window, w) for w in (0, 1))

    def text_words(self, r: int) -> list[bytes]:
        return self.data[self.bounds[r] : self.bounds[r + 1]].tobytes().split()


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _by_row(rows: int, of: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the digest of all words, and the stretches (fp, hi, lo) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = Stretches(part.column(1))
            rows = part.num_rows
            lists = [_by_row(rows, s.row, v) for v in (s.fp, s.hi, s.lo)]
            digests = pa.array([_digest(s.text_words(r)) for r in range(rows)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(s.first).astype(np.int64)), digests, *lists], ["doc_id", "n_words", "digest", *KEY])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, digest string, fp array<long>, hi array<long>, lo array<long>")


def _listed(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x or [], np.int64).view(np.uint64) for x in column.to_pylist()]


def expand(texts: DataFrame) -> DataFrame:
    """(a, b, doc_id, old) for every window of the stretches asked for by rows (doc_id, old, spans, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = Stretches(part.column(3))
            asked = [np.isin(s.hi[a:b], x) for x, a, b in zip(_listed(part.column(2)), *_row_bounds(s, part.num_rows), strict=True)]
            chosen = np.flatnonzero(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
            if not len(chosen):
                continue
            at, a, b = s.windows(chosen)
            row = pa.array(np.searchsorted(s.first, at, side="right") - 1)
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), part.column(0).take(row), part.column(1).take(row)], ["a", "b", "doc_id", "old"])

    return texts.select("doc_id", "old", "spans", "text").mapInArrow(run, "a long, b long, doc_id long, old boolean")


def _row_bounds(s: Stretches, rows: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(s.row, np.arange(rows + 1))
    return at[:-1], at[1:]


def strip(texts: DataFrame) -> DataFrame:
    """Removes what the decisions (spans, singles) of each row cover: n_words, n_removed, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = Stretches(part.column(3))
            n, gone, digest, kept = [], [], [], []
            spans, singles = _listed(part.column(1)), _listed(part.column(2))
            for r, (lo, hi) in enumerate(zip(*_row_bounds(s, part.num_rows), strict=True)):
                base, size = s.first[r], int(s.first[r + 1] - s.first[r])
                edge = np.zeros(size + 1, np.int64)
                whole = np.isin(s.hi[lo:hi], spans[r])
                np.add.at(edge, s.start[lo:hi][whole] - base, 1)
                np.add.at(edge, s.end[lo:hi][whole] - base, -1)
                if len(singles[r]):
                    at, a, _ = s.windows(np.arange(lo, hi)[~whole])
                    at = at[np.isin(a, singles[r])] - base
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + s.window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                left = [w for w, k in zip(s.text_words(r), stay, strict=True) if k]
                n.append(size), gone.append(size - len(left)), digest.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return texts.select("doc_id", "spans", "singles", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


class SubstringIndex:
    """The index over all batches so far, in a folder of its own or in ``root``, where a later session finds it again.

    >>> index = SubstringIndex(spark)
    >>> result = index.add(batch, corpus)   # corpus: the batch and everything added before

    A window repeats if its words start in an earlier batch, or in the same batch in a
    document with a smaller doc_id.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.ws = Workspace(spark, "substring")
        if root:
            self.ws.root = root.rstrip("/")
        self.tag = "cuegrid_" + hashlib.md5(self.ws.root.encode()).hexdigest()
        self.runs: list[str] = []
        self.batches, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        while (text := self.ws.read_text(f"log/{self.batches:08d}")) is not None:
            self.batches, self.runs, self.buckets = self.batches + 1, *json.loads(text)

    def _table(self, name: str, columns: str, by: list[str]) -> DataFrame:
        """A table written by ``_sorted``, also in an earlier session."""
        keys = ", ".join(by)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.tag}_{name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.ws.path(name)}'")
        return self.spark.table(f"{self.tag}_{name}")

    def _sorted(self, rows: DataFrame, name: str, by: list[str]) -> DataFrame:
        rows.write.mode("overwrite").bucketBy(self.buckets, *by).sortBy(*by).option("path", self.ws.path(name)).format("parquet").saveAsTable(f"{self.tag}_{name}")
        return self.spark.table(f"{self.tag}_{name}")

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tag}_{name}")
        self.ws.drop(*names)

    def _run(self, name: str) -> DataFrame:
        return self._table(f"run{name}", "fp BIGINT, hi BIGINT, lo BIGINT, doc_id BIGINT", KEY)

    def _prints(self, name: str) -> DataFrame:
        return self._table(f"prints{name}", "fp BIGINT, n BIGINT", ["fp"])

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Spark trusts the order within buckets of a single file."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, before)

    def _write_run(self, rows: DataFrame, name: str) -> None:
        run = self._sorted(rows.select(*KEY, "doc_id"), f"run{name}", KEY)
        self._sorted(run.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), f"prints{name}", ["fp"])

    def compact(self) -> None:
        """Merges all runs into one; stretches are distinct over all runs already."""
        old, name = self.runs, f"m{self.batches}"
        history = self._run(old[0])
        for r in old[1:]:
            history = history.unionByName(self._run(r))
        self._write_run(history.repartition(self.buckets, *KEY), name)
        self.runs = [name]
        self._drop(*[f"{kind}{r}" for r in old for kind in ("run", "prints")])

    def _known(self, batch: DataFrame, table: Callable[[str], DataFrame], by: list[str]) -> DataFrame:
        """Adds ``old`` to rows sorted by ``by``: whether one of the runs has them. Each run is merge-joined by itself."""
        for r in self.runs:
            seen = table(r).select(*by, F.lit(True).alias(f"_{r}"))
            batch = batch.join(seen.hint("merge"), by, "left")
        marks = [f"_{r}" for r in self.runs]
        return batch.withColumn("old", F.coalesce(*marks, F.lit(False))).drop(*marks)

    def _beside(self, few: DataFrame) -> DataFrame:
        """A written table of one number a row for joins with a large one, which stays where it is if the table is small."""
        return F.broadcast(few) if few.count() <= FEW_GROUPS else few

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and kept of every row of the batch.

        ``kept`` is the rest of the text, its words joined by one space, or null where
        nothing was removed and the text stands. Null or empty text: no words. Null
        doc_id: compared with nothing. Rows that share a doc_id never repeat each other.
        Texts shorter than a window stay. Empty batch: no rows. Other columns are ignored.
        """
        ws, k = self.ws, self.batches
        rows = ws.save(extract(batch), f"rows{k}")
        spread = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.arrays_zip(*KEY)).alias("s")).select("doc_id", "s.*")
        with self._in_order():
            firsts = self._sorted(spread.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), f"firsts{k}", KEY)
            marked = self._known(firsts, self._run, KEY)
            again = ws.save(marked.where("old or last > doc_id").select(*KEY, F.when(~F.col("old"), F.col("doc_id")).alias("first")), f"again{k}")
            self._write_run(marked.where("not old"), str(k))
            fresh, prints = self._run(str(k)), self._prints(str(k))
            # fingerprints with several stretches, at least one of them new
            several = ws.save(self._known(prints, self._prints, ["fp"]).where("old or n > 1").select("fp"), f"several{k}")
        whole = ws.save(spread.join(again, KEY).where("first is null or doc_id > first").select("doc_id", "hi"), f"whole{k}")
        beside = self._beside(several)
        told = fresh.join(beside, "fp").select("doc_id", "hi", F.lit(False).alias("old"))
        for r in self.runs:
            told = told.unionByName(self._run(r).join(beside, "fp").select("doc_id", "hi", F.lit(True).alias("old")))
        asked = ws.save(told.groupBy("doc_id", "old").agg(F.collect_set("hi").alias("spans")), f"asked{k}")
        # the texts that matter, fetched once and dealt by document once
        ids = ws.save(asked.select("doc_id").union(whole.select("doc_id")).distinct(), f"ids{k}")
        texts = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(self._beside(ids), "doc_id")
        texts = self._sorted(texts.repartition(self.buckets, "doc_id"), f"texts{k}", ["doc_id"])
        windows = ws.save(expand(texts.join(asked, "doc_id")), f"windows{k}")
        new = F.when(~F.col("old"), F.col("doc_id"))
        owner = windows.groupBy("a", "b").agg(F.max("old").alias("any_old"), F.min(new).alias("first"), F.max(new).alias("last"))
        owner = ws.save(owner.where("last is not null and (any_old or last > first)"), f"owner{k}")
        single = windows.where("not old").join(owner, ["a", "b"]).where("any_old or doc_id > first").select("doc_id", F.col("a").alias("one")).distinct()
        spans = whole.groupBy("doc_id").agg(F.collect_set("hi").alias("spans"))
        decisions = spans.join(single.groupBy("doc_id").agg(F.collect_set("one").alias("singles")), "doc_id", "full")
        decisions = ws.save(decisions, f"decisions{k}")
        same = rows.join(decisions.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
        same = same.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
        out = ws.save(same.unionByName(strip(texts.join(decisions, "doc_id"))), f"result{k}")
        self.runs, self.batches = [*self.runs, str(k)], k + 1
        if len(self.runs) > MOST_RUNS:
            self.compact()
        # the last write: from here on the batch belongs to the index
        if not ws.create_text(f"log/{k:08d}", json.dumps([self.runs, self.buckets])):
            raise RuntimeError(f"another writer has added batch {k} to this index")
        self._drop(*[f"{t}{k}" for t in ("rows", "firsts", "again", "several", "whole", "asked", "ids", "texts", "windows", "owner", "decisions")])
        return out


def remove_repeats(docs: DataFrame, batches: int = 6) -> DataFrame:
    """The whole table, added to a new index in ``batches`` ranges of doc_id in ascending order."""
    spark = docs.sparkSession
    index = SubstringIndex(spark)
    if batches > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    else:
        cuts = []
    cuts = sorted(set(cuts))
    ranges = list(zip([None, *cuts], [*cuts, None], strict=True))
    id_ = F.col("doc_id")
    out = None
    for low, high in ranges:
        part, upto = docs, docs
        if high is not None:
            part = upto = docs.where(id_ <= high)
        if low is not None:
            part = part.where((id_ > low) | id_.isNull()) if high is None else part.where(id_ > low)
        found = index.add(part, upto)
        out = found if out is None else out.unionByName(found)
    index._drop(*[f"{kind}{r}" for r in index.runs for kind in ("run", "prints")])
    return out
