"""Token counts kept up to date by signed deltas.

Batches of inserts, deletes and revisions are turned into signed rows per document, and
these into additive totals by source, language and tokenizer version. A batch is written
under a name of its own and counts from the moment at which a numbered entry in the log
names it. Entries are created exclusively: of two writers only one gets a number, and the
other works its batch out again on the state that has changed. Repeating a batch, whole or
after a failure half-way, changes nothing, in this session or a later one.

Signed rows lie sorted by document; every few batches they are summed into one current row
per document. A batch reads the ranges of ids only in which the documents lie that it addresses.
"""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, chunks
from .packing import byte_encoder

EVENT = "doc_id long, op string, source string, lang string, version string, n_tokens long"
DELTA = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
GROUP = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]
#: Batches after which their rows are summed up; ranges of ids that a commit reads; cells that ids are told apart by.
MOST_BATCHES, RANGES, CELLS = 8, 64, 1024


class TokenRollup:
    """Totals over all committed batches below ``root`` (a folder of its own by default)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.ws = Workspace(spark, "rollup")
        if root:
            self.ws.root = root.rstrip("/")

    def log(self) -> tuple[int, list[dict]]:
        """(how many entries there are, those that count): the last summing up of all before it, and the batches since.

        A summing up names all batches before it, so older entries need not be read. An
        entry is one small file.
        """
        size = self.ws.numbered("log")
        out: list[dict] = []
        while (text := self.ws.read_text(f"log/{size:08d}")) is not None:  # entered meanwhile
            size += 1
        for k in reversed(range(size)):
            out.append(json.loads(self.ws.read_text(f"log/{k:08d}")))
            if not out[-1]["batch"]:
                break
        return size, out[::-1]

    def _enter(self, number: int, entry: dict) -> bool:
        """Whether this writer got the number."""
        return self.ws.create_text(f"log/{number:08d}", json.dumps(entry))

    @staticmethod
    def _names(log: list[dict]) -> list[str]:
        return [name for e in log for name in (e["before"] if not e["batch"] else [e["batch"]])]

    def batches(self) -> list[str]:
        """Names of the committed batches, in the order of their entries."""
        return self._names(self.log()[1])

    def _read(self, kind: str, log: list[dict]) -> DataFrame:
        """The rows that count after the entries of ``log``."""
        schema = f"{DELTA}, attempt string"
        paths = [self.ws.path(f"{kind}/attempt={e['attempt']}") for e in log]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.ws.path(kind)).parquet(*paths)

    def _write(self, rows: DataFrame, attempt: str) -> None:
        # sorted ranges of ids, so that a later commit finds a document by the least and greatest id of pages and files; equal ids, as those of rows without one, are spread by what else they hold
        rows = rows.withColumn("_spread", F.xxhash64(*GROUP, *SUMS))
        rows = rows.repartitionByRange("doc_id", "_spread").sortWithinPartitions("doc_id").drop("_spread")
        rows.write.mode("overwrite").parquet(self.ws.path(f"deltas/attempt={attempt}"))
        totals = _summed(self._read("deltas", [{"attempt": attempt}])).withColumn("doc_id", F.lit(None).cast("long"))
        totals.write.mode("overwrite").parquet(self.ws.path(f"totals/attempt={attempt}"))

    def _held(self, log: list[dict], aimed: DataFrame) -> DataFrame:
        """What the documents of ``aimed`` (doc_id, version) have, read from the ranges of ids that they lie in."""
        near = F.lit(False)
        for low, high in id_ranges(aimed):
            near = near | F.col("doc_id").between(low, high)
        held = self._read("deltas", log).where(near).join(aimed, ["doc_id", "version"], "left_semi")
        return held.groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0")

    def _discard(self, attempt: str) -> None:
        self.ws.drop(f"deltas/attempt={attempt}", f"totals/attempt={attempt}")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Applies events (doc_id, op, source, lang, version, n_tokens) once; False if it was applied before.

        ``insert`` adds a row's count. ``revise`` and ``delete`` first take back all that
        the document has under that version from earlier batches; ``revise`` then adds
        its new count, also under another source or language. Of several revisions of a
        document under one version in one batch that with the largest count holds (then
        the least source and language, null first); beside a revision a deletion takes back no more.
        Null source or language: a group of its own. Null doc_id: can be inserted, never
        revised or deleted. Null count: zero. Repeated inserts all count, also within a
        batch, and are not taken back by it. Empty batch: committed, changes nothing.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        events = events.select("doc_id", "op", *GROUP, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        counted = lambda op: events.where(F.col("op") == op).select("doc_id", *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        one = F.min(F.struct((-F.col("n_tokens")).alias("less"), *GROUP[:2], *SUMS))
        revised = counted("revise").where("doc_id is not null").groupBy("doc_id", "version").agg(one.alias("_r"))
        revised = revised.select("doc_id", "_r.source", "_r.lang", "version", "_r.n_docs", "_r.n_tokens")
        aimed = events.where(F.col("op").isin("revise", "delete")).select("doc_id", "version").distinct()
        while True:
            size, log = self.log()
            if batch in self._names(log):
                return False
            back = self._held(log, aimed).select("doc_id", *GROUP, *[(-F.col(c)).alias(c) for c in SUMS])
            attempt = uuid.uuid4().hex
            self._write(counted("insert").unionByName(revised).unionByName(back), attempt)
            if self._enter(size, {"batch": batch, "attempt": attempt}):
                break
            self._discard(attempt)
        if sum(bool(e["batch"]) for e in log) + 1 > MOST_BATCHES:
            self.sum_up()
        return True

    def sum_up(self) -> bool:
        """One current row per document, version, source and language in place of all signed rows; False if another writer was first.

        Tables that are no longer read stay, as a reader may still hold them; ``vacuum`` deletes them.
        """
        size, log = self.log()
        rows = self._read("deltas", log).groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        attempt = uuid.uuid4().hex
        self._write(rows.where("n_docs <> 0 or n_tokens <> 0"), attempt)
        if self._enter(size, {"batch": None, "attempt": attempt, "before": self._names(log), "replaced": [e["attempt"] for e in log]}):
            return True
        self._discard(attempt)
        return False

    def vacuum(self) -> int:
        """Deletes the tables that the last summing up has replaced; how many. To be called when no reader is older than it."""
        gone = [a for e in self.log()[1] if not e["batch"] for a in e["replaced"]]
        for attempt in gone:
            self._discard(attempt)
        return len(gone)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that have become empty are left out."""
        return _summed(self._read("totals", self.log()[1])).where("n_docs <> 0 or n_tokens <> 0")

    def recount(self) -> DataFrame:
        """The same from the documents' rows, to check the totals."""
        return _summed(self._read("deltas", self.log()[1])).where("n_docs <> 0 or n_tokens <> 0")


def id_ranges(rows: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all doc_id of the rows, the widest gaps between them left out."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    # a row for each cell that is not empty
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
    found = rows.where("doc_id is not null").groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    spans = sorted((r["a"], r["b"]) for r in found)
    gaps = sorted(range(1, len(spans)), key=lambda k: spans[k - 1][1] - spans[k][0])[: most - 1]
    bounds = [0, *sorted(gaps), len(spans)]
    return [(spans[x][0], spans[y - 1][1]) for x, y in zip(bounds, bounds[1:], strict=False)]


def _summed(rows: DataFrame) -> DataFrame:
    # few groups: partial sums leave each task one row per group
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


_counters: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """Number of tokens under a byte-level vocabulary file (``.json`` or ``.tiktoken``)."""
    if path not in _counters:
        if path.endswith(".json"):
            encode = byte_encoder(path)
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _counters[path] = lambda text: len(encode(text))
    return _counters[path]


def tidy(text: str) -> str:
    """A revision of a text: no blanks at line ends, no runs of blank lines."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", text))


def counted(docs: DataFrame, vocabularies: list[str], revise: Callable[[str], str] = tidy) -> DataFrame:
    """doc_id, source, lang, version, n_tokens and the count after revision (null if the text stays) of each row and vocabulary.

    Null or empty text: zero tokens. Version: the file's name without its ending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [(os.path.basename(v).rsplit(".", 1)[0], counter(v)) for v in vocabularies]
        for part in chunks(batches):
            texts = [t or "" for t in part.column(3).to_pylist()]
            tidied = [revise(t) for t in texts]
            for version, count in counts:
                now = [count(t) for t in texts]
                new = [None if t == n else count(n) for t, n in zip(texts, tidied, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([version] * len(texts), pa.string()), pa.array(now, pa.int64()), pa.array(new, pa.int64())],
                    ["doc_id", "source", "lang", "version", "n_tokens", "revised"],
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return given.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long, revised long")


def exact_copies(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id of documents whose text is that of a document with a smaller doc_id.

    Both sides of the join are written first, so that Spark can split a text with many copies.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    keyed = ws.save(keyed, "keyed")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    first = ws.save(first, "first")
    return keyed.join(first, "key").where("doc_id > first").select("doc_id").distinct()


def corpus_rollup(docs: DataFrame, vocabularies: list[str]) -> TokenRollup:
    """A corpus's life: all documents inserted, tidied texts revised, exact copies deleted, a batch repeated."""
    spark = docs.sparkSession
    rollup = TokenRollup(spark)
    rows = rollup.ws.save(counted(docs, vocabularies), "counted")
    event = lambda op, n: [F.col("doc_id"), F.lit(op).alias("op"), *map(F.col, GROUP), n.cast("long").alias("n_tokens")]
    load = rows.select(*event("insert", F.col("n_tokens")))
    rollup.commit("load", load)
    rollup.commit("tidy", rows.where("revised is not null").select(*event("revise", F.col("revised"))))
    copies = exact_copies(rollup.ws, docs)
    rollup.commit("copies", rows.join(copies, "doc_id").select(*event("delete", F.lit(None))))
    rollup.commit("load", load)
    return rollup
