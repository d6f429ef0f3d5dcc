"""Track documents: nested JSON with a track's words, cues and spans, and its flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double>"
SEGMENT = f"struct<start:double,end:double,text:string,words:array<{WORD}>,lyric:boolean>"
#: Spans come as arrays of numbers of any length and turns mix numbers with a label, hence text.
TRACK = f"language string, segments array<{SEGMENT}>, word_segments array<{WORD}>, vad_speech array<array<double>>, shot_changes array<double>, sing_spans array<array<double>>, speaker_turns array<array<string>>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; one that is no object, or has no segments, fails with its path."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("track_id"), "value")
    rows = texts.withColumn("t", F.from_json("value", TRACK))
    broken = F.col("t").isNull() | F.col("t.segments").isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("not a track document: "), F.col("track_id")))).otherwise(F.col("track_id"))
    return rows.select(checked.alias("track_id"), "t.*")


def words(tracks: DataFrame, *more: str) -> DataFrame:
    """track_id, seq, text, start, end of the words, and ``more`` columns of their track."""
    return tracks.select("track_id", *more, F.posexplode("word_segments").alias("seq", "w")).select("track_id", "seq", F.col("w.word").alias("text"), "w.start", "w.end", *more)


def cues(tracks: DataFrame) -> DataFrame:
    rows = tracks.select("track_id", F.col("language").alias("lang"), F.posexplode("segments").alias("seq", "c"))
    data = F.transform(F.coalesce("c.words", F.array().cast(f"array<{WORD}>")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))
    return rows.select("track_id", "seq", "lang", "c.start", "c.end", "c.text", F.coalesce("c.lyric", F.lit(False)).alias("lyric"), data.alias("word_data"))


def spans(tracks: DataFrame, field: str) -> DataFrame:
    """track_id, seq, start, end of a span field; malformed elements go one by one."""
    rows = tracks.select("track_id", F.posexplode(field).alias("seq", "s")).where("size(s) = 2 and s[0] is not null and s[1] > s[0]")
    return rows.select("track_id", "seq", F.col("s")[0].alias("start"), F.col("s")[1].alias("end"))


def turns(tracks: DataFrame) -> DataFrame:
    rows = tracks.select("track_id", F.posexplode("speaker_turns").alias("seq", "s")).where("size(s) = 3")
    rows = rows.select("track_id", "seq", F.expr("try_cast(s[0] as double)").alias("start"), F.expr("try_cast(s[1] as double)").alias("end"), F.col("s")[2].alias("speaker"))
    return rows.where("end > start and speaker is not null")


def shots(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.explode("shot_changes").alias("t")).where("t is not null").distinct()


def documents(cues_: DataFrame, words_: DataFrame, lang: DataFrame) -> DataFrame:
    """track_id, value: the JSON document of each track, from its cues, words and language (track_id, lang)."""
    segment = F.struct("seq", F.struct("start", "end", "text", "lyric").alias("x"))
    c = cues_.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda s: s["x"]).alias("segments"))
    word = F.struct("seq", F.struct(F.col("text").alias("word"), "start", "end").alias("x"))
    w = words_.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda s: s["x"]).alias("word_segments"))
    rows = c.join(w, "track_id", "left").join(lang.select("track_id", F.col("lang").alias("language")), "track_id", "left")
    return rows.select("track_id", F.to_json(F.struct("language", "segments", "word_segments")).alias("value"))
