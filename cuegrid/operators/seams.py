"""Places where models are called: a function per chunk or per window of cues, failures kept as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import fresh_folder, settled
from .intervals import TRACK


def per_chunk(chunks: DataFrame, call: Callable[[dict], list[dict]], schema: str, rounds: int = 1) -> DataFrame:
    """Rows that ``call`` gives for each chunk, with the chunk's track_id and chunk_no and an ``error``.

    A chunk that fails ``rounds`` times gives one row with the error and nothing else; the
    others are not touched. Chunks are dealt out evenly, as one may take long.
    """
    kinds = f"{TRACK} {chunks.schema[TRACK].dataType.simpleString()}, chunk_no int, {schema}, error string"
    names = [c.strip().split(" ")[0] for c in kinds.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for chunk in frame.to_dict("records"):
                rows, error = _tried(lambda c=chunk: call(c), rounds, 0)
                own = {TRACK: chunk[TRACK], "chunk_no": chunk["chunk_no"]}
                out += [own | {"error": error}] if error else [own | r for r in rows]
            yield pd.DataFrame(out, columns=names)

    return chunks.repartition(TRACK, "chunk_no").mapInPandas(run, kinds)


def _tried(call: Callable[[], object], rounds: int, wait_s: float) -> tuple[object, str | None]:
    for k in range(rounds):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001 - a model may fail in any way; the failure is the row's result
            error = f"{type(e).__name__}: {e}"
            if k + 1 < rounds and wait_s:
                time.sleep(wait_s * 4**k)
    return None, error


def all_failed(results: DataFrame) -> DataFrame:
    """Tracks of whose chunks every one failed."""
    return results.groupBy(TRACK).agg(F.bool_and(F.col("error").isNotNull()).alias("_bad"), F.first("error", True).alias("error")).where("_bad").drop("_bad")


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items (track_id, i, t) that no finished answer (track_id, signature, i) covers; the signature is of the source text."""
    signed = items.withColumn("signature", F.sha1(F.col("t").cast("binary")))
    return signed.join(done.select(TRACK, "signature", "i"), [TRACK, "signature", "i"], "left_anti")


ANSWER = "`window` int, i long, signature string, t string, error string"


def _state(items: DataFrame, folder: str) -> DataFrame:
    """What the folder holds of earlier waves; nothing if it is new."""
    spark, schema = items.sparkSession, f"{TRACK} {items.schema[TRACK].dataType.simpleString()}, {ANSWER}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _next_windows(signed: DataFrame, state: DataFrame, tried: DataFrame, tail: int) -> DataFrame:
    """For each track the first open window's open items, and the last ``tail`` answers before that window (``known``)."""
    key = [TRACK, "signature", "i"]
    good = state.where("error is null").select(*key, "t").dropDuplicates(key)
    rows = signed.join(good.withColumnRenamed("t", "known"), key, "left")
    open_ = rows.where("known is null").join(tried, [TRACK, "window"], "left_anti")
    at = open_.groupBy(TRACK).agg(F.min("window").alias("_at"))
    asked = open_.join(at, TRACK).where("window = _at").drop("_at")
    before = rows.where("known is not null").join(at, TRACK).where("window < _at")
    late = F.row_number().over(Window.partitionBy(TRACK).orderBy(F.desc("window"), F.desc("i")))
    return asked.unionByName(before.withColumn("_r", late).where(F.col("_r") <= tail).drop("_r", "_at"))


def answer_windows(items: DataFrame, ask: Callable[[list[dict], list[dict]], dict[int, str]], folder: str | None = None, tail: int = 3, rounds: int = 3, wait_s: float = 2.0, most_waves: int | None = None) -> DataFrame:
    """Answers (track_id, window, i, t, error) to items (track_id, window, i, t), window after window within a track.

    ``ask`` gets a window's open items and the last ``tail`` answered ones before it, and
    gives texts by index; answers to other indexes are dropped. A window that fails after
    its retries has one row with the error, and the next goes on.

    A wave asks the first open window of every track at once and adds the answers to
    ``folder``, told apart by track, index and the signature of the text. A later run with
    that folder asks only for what is open: texts that are new or have changed, and windows
    that failed or were not reached. Without a folder a new one below the checkpoints is
    used. A task holds one window.
    """
    spark, kind = items.sparkSession, items.schema[TRACK].dataType.simpleString()
    folder = folder or fresh_folder(spark, "answers")
    signed = settled(items.select(TRACK, F.col("window").cast("int").alias("window"), F.col("i").cast("long").alias("i"), "t", F.sha1(F.col("t").cast("binary")).alias("signature")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["window", "i"])
        known, wanted = rows[rows["known"].notna()], rows[rows["known"].isna()]
        before = [{"i": int(i), "t": t} for i, t in zip(known["i"], known["known"], strict=True)]
        got, error = _tried(lambda: ask(wanted[["i", "t"]].to_dict("records"), before), rounds, wait_s)
        window, track = int(wanted["window"].iloc[0]), wanted[TRACK].iloc[0]
        if error:
            out = [(track, window, None, None, None, error)]
        else:
            # an item without an answer is answered with nothing: asked again in a later run only
            out = [(track, window, int(i), s, got[i], None) for i, s in zip(wanted["i"], wanted["signature"], strict=True) if i in got]
            out += [(track, window, None, None, None, None)]
        return pd.DataFrame(out, columns=[TRACK, "window", "i", "signature", "t", "error"]).astype({"i": "Int64"})

    tried = signed.select(TRACK, "window").where("false")
    wave = 0
    while most_waves is None or wave < most_waves:
        batch = settled(_next_windows(signed, _state(items, folder), tried, tail))
        if batch.isEmpty():
            break
        asked = batch.where("known is null").select(TRACK, "window").distinct()
        # each track is in the batch with one window and a short tail
        batch.groupBy(TRACK).applyInPandas(run, f"{TRACK} {kind}, {ANSWER}").write.mode("append").parquet(folder)
        tried = settled(tried.unionByName(asked))
        wave += 1
    state = _state(items, folder)
    best = state.where("error is null and i is not null").dropDuplicates([TRACK, "signature", "i"]).drop("window", "error")
    answers = signed.drop("t").join(best, [TRACK, "signature", "i"]).select(TRACK, "window", "i", "t", F.lit(None).cast("string").alias("error"))
    open_ = signed.join(best.select(TRACK, "signature", "i"), [TRACK, "signature", "i"], "left_anti").select(TRACK, "window").distinct()
    failed = state.where("error is not null").groupBy(TRACK, "window").agg(F.min("error").alias("error")).join(open_, [TRACK, "window"], "left_semi")
    return answers.unionByName(failed.select(TRACK, "window", F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("t"), "error"))
