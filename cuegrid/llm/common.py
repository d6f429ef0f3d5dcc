"""Shared pieces of the corpus operators: durable tables, distributed ranks, Arrow chunks.

Intermediate results that are read more than once are written as Parquet below the
folder named by ``spark.checkpoint.dir``, which every executor can reach, so that a lost
executor costs a task retry and never a missing block.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuegrid-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


class Workspace:
    """A folder of intermediate Parquet tables below the shared folder.

    >>> ws = Workspace(spark, "mix")
    >>> table = ws.save(df, "sizes")      # written once, then read back
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cuegrid/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _files(self, target: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def create_text(self, name: str, text: str) -> bool:
        """Writes a small file that must not exist yet; False if another writer was first."""
        files, path = self._files(self.path(name))
        try:
            stream = files.create(path, False)
        except Py4JJavaError as e:
            if files.exists(path):
                return False
            raise e
        stream.write(f"{text}\n".encode())
        stream.close()
        return True

    def numbered(self, name: str) -> int:
        """How many numbered files a folder holds: one more than the greatest number."""
        files, path = self._files(self.path(name))
        if not files.exists(path):
            return 0
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return 1 + max((int(n) for n in names if n.isdigit()), default=-1)

    def read_text(self, name: str, patience_s: float = 10.0) -> str | None:
        """What ``create_text`` wrote, or None; waits for a writer that is not done."""
        files, path = self._files(self.path(name))
        until = time.monotonic() + patience_s
        while files.exists(path):
            stream = files.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                return text
            if time.monotonic() > until:
                raise TimeoutError(f"{self.path(name)} was begun and not finished")
            time.sleep(0.1)
        return None

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes what an operator returns and deletes the tables that it was made from."""
        out = self.save(df, name)
        files, root = self._files(self.root)
        for status in files.listStatus(root):
            if status.getPath().getName() != name:
                files.delete(status.getPath(), True)
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for target in map(self.path, names):
            files, path = self._files(target)
            files.delete(path, True)


def ranked(ws: Workspace, df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Global running totals without a single-task window.

    Rows are dealt by range over ``order`` and written with the number of their range;
    each range then needs only its own window and the totals of the ranges before it.
    ``sums`` maps a new column to the long column that it runs over; the new column holds
    the total up to and including the row. ``rn`` counts rows from 0.
    """
    dealt = ws.save(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name
    )
    totals = dealt.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()]
    )
    # one row per range partition: bounded by the number of partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_0_{new}") for new in sums],
    )
    offsets = ws.save(offsets, f"{name}_offsets")
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select(
        "*",
        (F.row_number().over(inside) - 1).cast("long").alias("_rn"),
        *[F.sum(c).over(upto).alias(f"_s_{new}") for new, c in sums.items()],
    )
    out = local.join(F.broadcast(offsets), "_range")  # bounded: a row per range
    return out.select(
        *df.columns,
        (F.col("_rn") + F.col("_n0")).alias("rn"),
        *[(F.col(f"_s_{new}") + F.col(f"_0_{new}")).alias(new) for new in sums],
    )


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        i = batch.schema.get_field_index(text)
        sizes = pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(sizes):
            if k > start and held + n > max_bytes:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def code_point_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Numbers distinct values from 0 in code-point order, null last.

    ``df`` holds one row per distinct value: a dimension such as the sources, not documents.
    """
    w = Window.orderBy(F.col(column).asc_nulls_last())
    return df.withColumn(name, F.row_number().over(w) - 1)
