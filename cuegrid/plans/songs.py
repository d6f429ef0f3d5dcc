"""Songs: detection from scores, the plan of what to skip, and the speech that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clean_speech_flag, sing_flag, song_flag
from ..operators import intervals as iv
from ..operators.folds import pack_segments
from ..operators.intervals import BUCKET_S, TRACK
from .durable import settled


def detect_song_spans(scores: DataFrame, width: float = 2.0, gap: float = 2.0, min_span: float = 3.0, bucket_s: float = BUCKET_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(song, sing, speech) spans from windows (track_id, t, speech, sing, music); song spans that hold singing are sing spans."""
    speech, sing, music = F.col("speech"), F.col("sing"), F.col("music")
    flagged = lambda f: iv.flagged_windows_to_spans(scores.select(TRACK, "t", f.alias("flag")), width, gap, min_span)
    song, clean = flagged(song_flag(speech, sing, music)), flagged(clean_speech_flag(speech, sing, music))
    sung = iv.within_spans(scores.where(sing_flag(speech, sing)).select(TRACK, "t"), song, bucket_s)
    at = sung.select(TRACK, F.col("t").alias("start"), F.col("t").alias("end"))
    hit = iv.interval_join(song, at, F.col("r_start") < F.col("end"), "closed", bucket_s)
    return song, hit.select(TRACK, "start", "end").distinct(), clean


def numbered(spans: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return spans.withColumn("seq", F.row_number().over(Window.partitionBy(TRACK).orderBy("start", "end")) - 1)


def plan_song_skip(
    songs: DataFrame, sings: DataFrame, segments: DataFrame, speech: DataFrame, silences: DataFrame, min_skip_s: float = 8.0, max_chunk_s: float = 120.0, bucket_s: float = BUCKET_S
) -> dict[str, DataFrame]:
    """expanded, cut, kept and chunks of each track.

    Long singing grows over its voiced block; clean speech that the segments miss is
    rescued after that; what is still long, and short singing apart from it, is cut out,
    edges snapped into silences; the rest is packed without crossing a cut.
    """
    length = F.col("end") - F.col("start")
    songs, sings, segments, speech, silences = map(settled, (songs, sings, segments.select(TRACK, "start", "end"), speech, silences))
    long_sing = sings.where(length >= min_skip_s)
    expanded = settled(iv.expand_to_voiced_blocks(numbered(segments.select(TRACK, "start", "end")), numbered(songs), long_sing, speech, bucket_s=bucket_s))
    rescued = settled(iv.rescue_speech(numbered(speech), segments, bucket_s=bucket_s).select(TRACK, "start", "end"))
    segments = segments.unionByName(rescued)
    silences = settled(iv.subtract_spans(numbered(silences.select(TRACK, "start", "end")), rescued, bucket_s))
    long_cut = expanded.where(length >= min_skip_s)
    short = iv.not_overlapping(numbered(sings.where(length < min_skip_s)), long_cut, bucket_s=bucket_s).select(TRACK, "start", "end")
    kept, cut = map(settled, iv.excise_spans(numbered(segments), settled(long_cut.unionByName(short)), silences, bucket_s=bucket_s))
    grouped = iv.group_by_spans(numbered(kept.select(TRACK, "start", "end")), cut, bucket_s)
    return {"expanded": expanded, "cut": cut, "kept": kept.select(TRACK, "start", "end"), "chunks": pack_segments(grouped, max_chunk_s, "grp")}


def timing_reference(voice: DataFrame, songs: DataFrame, speech: DataFrame, rescued: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Speech spans to time words by: voice without what is sung, with the rescued speech outside songs."""
    sung = iv.subtract_spans(numbered(songs), speech, bucket_s).select(TRACK, "start", "end")
    none = songs.where("false").select(TRACK, "start", "end")
    kept, _ = iv.excise_spans(numbered(voice.select(TRACK, "start", "end")), settled(sung), none, bucket_s=bucket_s)
    added = iv.subtract_spans(numbered(rescued), songs, bucket_s).select(TRACK, "start", "end").where("end > start")
    return iv.coalesce_spans(kept.select(TRACK, "start", "end").unionByName(added))
