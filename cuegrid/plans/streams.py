"""Streams of words, spans, scores and turns made from general tables.

Stand-ins for recordings: times are whole thousandths, divided once, so that every engine
gets the same doubles.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import class_max

WORDS = "[^ \\t\\n\\r\\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_track(documents: DataFrame) -> DataFrame:
    """Texts dealt out by doc_id before they are taken apart: a text is a fifth of its words in a shuffle.

    Windows over the words of a track then need no shuffle of their own. The number of
    parts grows with the input, so that a part's words can be sorted in memory.
    """
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * documents.rdd.getNumPartitions())
    return documents.repartition(parts, "doc_id")


def word_stream(documents: DataFrame) -> DataFrame:
    """Words (track_id, seq, text, start, end, lang) of documents: 60 ms a character, a pause by what ends the word."""
    rows = by_track(documents.select("doc_id", "lang", "text")).select(F.col("doc_id").alias("track_id"), "lang", F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("seq", "text"))
    dur = F.length("text") * 60
    ends = lambda marks: functools.reduce(operator.or_, [F.endswith("text", F.lit(m)) for m in marks])
    pause = F.when(ends(".!?"), 800).when(ends(",;:"), 450).otherwise(50)
    before = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(dur + pause).over(before), F.lit(0))
    return rows.select("track_id", "seq", "lang", "text", (start / 1000.0).alias("start"), ((start + dur) / 1000.0).alias("end"))


def event_spans(events: DataFrame) -> DataFrame:
    """Spans (track_id, seq, kind, start, end) of events, in hours since the start of 2024."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    start, length = F.floor(micros / 3600000), F.floor(F.col("value") * 50)
    return events.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (start / 1000.0).alias("start"), ((start + length) / 1000.0).alias("end"))


def score_windows(embeddings: DataFrame) -> DataFrame:
    """Windows (track_id, t, speech, sing, music) with the first components of embeddings as class scores."""
    probs = F.col("embedding")
    return embeddings.select(
        F.col("label").alias("track_id"),
        F.col("vec_id").cast("double").alias("t"),
        class_max(probs, (0, 4, 6, 7)).alias("speech"),
        class_max(probs, (27, 28, 29, 30, 31, 36, 37)).alias("sing"),
        class_max(probs, (50, 51, 52, 53)).alias("music"),
    )


def turn_stream(conversations: DataFrame) -> DataFrame:
    """Turns (track_id, seq, speaker, start, end, text): 40 ms a character, each reaching 400 ms into the next."""
    n = F.length("text") * 40
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n + 200).over(before), F.lit(0))
    return conversations.select(F.col("conv_id").alias("track_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), (start / 1000.0).alias("start"), ((start + n + 400) / 1000.0).alias("end"), "text")
