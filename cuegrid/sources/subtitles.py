"""Subtitle files as tables of cues, and back.

A table of cues has (track_id, seq, start, end, text, lyric). Reading keeps one row per
file until its blocks are exploded; writing groups a track's lines, which are as many as a
recording has, into one text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.stretches import computed
from ..functions.text import ass_time, is_lyric, lyric_display, lyric_text, parse_time, srt_time, vtt_time

FORMATS = ("vtt", "srt", "ass", "ssa")
# The standard event fields of the format, in order.
ASS_FIELDS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
# File endings of media, the preferred first.
MEDIA_RANK = ["mkv", "mp4", "mov", "webm", "avi", "m4v", "ts", "flv", "m4a", "mp3", "wav", "flac", "aac", "ogg", "opus"]


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes to text: a byte order mark decides, then UTF-8, then GB18030, then Windows-1252; null if none fits."""

    def one(b: bytes) -> str | None:
        marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
        for name in [n for m, n in marks if b.startswith(m)][:1] or ["utf-8", "gb18030", "cp1252"]:
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return pd.Series([None if b is None else one(bytes(b)) for b in content], dtype=object)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """track_id (the file's path), ext and text of subtitle files in whatever encoding."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(F.col("path").alias("track_id"), ext.alias("ext"), decode_text("content").alias("text"))


def sniffed(text: Column) -> Column:
    """``vtt`` or ``ass`` by the first line that is not blank, else null."""
    line = F.lower(F.trim(F.regexp_extract(F.regexp_replace(text, "^\ufeff", ""), r"(?m)^\s*(\S.*)$", 1)))
    return F.when(line.startswith("webvtt"), "vtt").when(line.startswith("[script info]") | line.startswith("[v4") | line.startswith("[events]"), "ass")


def checked(files: DataFrame) -> DataFrame:
    """Fails on endings that are no subtitles and on content of the other family."""
    family = F.when(F.col("ext").isin("ass", "ssa"), "ass").otherwise("text")
    found = F.when(sniffed(F.col("text")) == "ass", "ass").when(sniffed(F.col("text")) == "vtt", "text")
    wrong = F.when(~F.col("ext").isin(*FORMATS), F.concat(F.lit("unsupported subtitle format: "), F.col("track_id")))
    wrong = wrong.when(F.col("text").isNull(), F.concat(F.lit("cannot decode: "), F.col("track_id"))).when(found != family, F.concat(F.lit("content and ending differ: "), F.col("track_id")))
    return files.withColumn("text", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("text")))


def _lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of WebVTT and SRT texts (track_id, text); cues may be without times, music without words goes."""
    blocks = files.select("track_id", F.posexplode(F.split(_lines(F.col("text")), "\n[ \t]*\n")).alias("_n", "_raw"))
    raw = F.regexp_replace(F.regexp_replace("_raw", r"^(?:(?U:\s)*\n)+", ""), r"(?U)\s+$", "")
    blocks = computed(blocks.withColumn("_raw", raw)).where(F.trim("_raw") != "")
    blocks = blocks.where(~F.upper(F.ltrim("_raw")).rlike("^(?:WEBVTT|NOTE|STYLE|REGION)")).withColumn("_l", F.split("_raw", "\n"))
    timing = F.when(F.get("_l", F.lit(0)).contains("-->"), 0).when(F.get("_l", F.lit(1)).contains("-->"), 1)
    blocks = computed(blocks.withColumn("_at", timing))
    line = F.get(F.col("_l"), F.col("_at"))
    body = F.when(F.col("_at").isNull(), F.col("_raw")).otherwise(F.array_join(F.slice("_l", F.col("_at") + 2, F.size("_l")), "\n"))
    blocks = computed(blocks.select("track_id", "_n", line.alias("_line"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("_cue"))).where("_cue <> ''")
    line = F.col("_line")
    start, end = parse_time(F.split(line, "-->")[0]), parse_time(F.get(F.split(F.trim(F.split(line, "-->", 2)[1]), r"\s+"), F.lit(0)))
    cues = computed(blocks.select("track_id", "_n", start.alias("start"), end.alias("end"), lyric_text(F.col("_cue")).alias("text"), is_lyric(F.col("_cue")).alias("lyric"))).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("_n")) - 1
    return cues.select("track_id", seq.alias("seq"), "start", "end", "text", "lyric")


def ass_plain(text: Column) -> Column:
    """Event text without overrides: line breaks and blanks resolved, italics as balanced tags."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"\{[^}]*\\i1(?![0-9])(?:(?!\\i[01](?![0-9]))[^}])*\}", "<i>")
    t = F.regexp_replace(t, r"\{[^}]*\\i0(?![0-9])(?:(?!\\i[01](?![0-9]))[^}])*\}", "</i>")
    t = F.regexp_replace(t, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"(?s)^<i>((?:(?!</?i>).)*)</i>$", "$1")
    parts = F.split(t, r"(?=</?i>)|(?<=<i>)|(?<=</i>)")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("d"))

    def step(acc: Column, p: Column) -> Column:
        close = p == "</i>"
        stray = close & (acc["d"] == 0)
        depth = acc["d"] + F.when(p == "<i>", 1).when(close & ~stray, -1).otherwise(0)
        return F.struct(F.when(stray, acc["s"]).otherwise(F.concat(acc["s"], p)).alias("s"), depth.alias("d"))

    t = F.aggregate(parts, start, step, lambda acc: F.concat(acc["s"], F.repeat(F.lit("</i>"), acc["d"])))
    t = F.regexp_replace(F.regexp_replace(t, r"\\[Nn]", "\n"), r"\\h", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def parse_ass(files: DataFrame) -> DataFrame:
    """Cues of ASS and SSA texts (track_id, text): dialogue of the events section, by its own field order, sorted by time."""
    lines = files.select("track_id", F.posexplode(F.split(_lines(F.col("text")), "\n")).alias("_n", "_line")).withColumn("_line", F.trim("_line"))
    upto = Window.partitionBy("track_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("_line").startswith("["), F.struct(F.lower("_line").alias("name"), F.col("_n").alias("at"))), ignorenulls=True).over(upto)
    lines = lines.withColumn("_section", head).where("_section.name = '[events]'")
    key, value = F.lower(F.trim(F.split("_line", ":", 2)[0])), F.get(F.split("_line", ":", 2), F.lit(1))
    lines = lines.withColumn("_key", key).withColumn("_value", value)
    names = F.transform(F.split("_value", ","), lambda x: F.lower(F.trim(x)))
    section = Window.partitionBy("track_id", "_section.at").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    standard = F.array(*map(F.lit, ASS_FIELDS))
    lines = lines.withColumn("_names", F.coalesce(F.last(F.when(F.col("_key") == "format", names), ignorenulls=True).over(section), standard)).where("_key = 'dialogue'")
    # the last field keeps its commas
    lines = lines.withColumn("_all", F.split("_value", ",")).withColumn("_k", F.size("_names"))
    parts = F.concat(F.slice("_all", F.lit(1), F.col("_k") - 1), F.array(F.array_join(F.slice(F.col("_all"), F.col("_k"), F.size("_all")), ",")))
    lines = computed(lines.where("size(_all) >= _k").withColumn("_parts", parts).select("track_id", "_n", "_names", "_parts"))
    field = lambda n: F.get(F.col("_parts"), (F.array_position("_names", n) - 1).cast("int"))
    cues = computed(lines.select("track_id", "_n", parse_time(field("start")).alias("start"), parse_time(field("end")).alias("end"), ass_plain(field("text")).alias("_cue")))
    cues = cues.where("start is not null and end is not null and _cue <> ''")
    cues = computed(cues.select("track_id", "_n", "start", "end", lyric_text(F.col("_cue")).alias("text"), is_lyric(F.col("_cue")).alias("lyric"))).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("start", "end", "_n")) - 1
    return cues.select("track_id", seq.alias("seq"), "start", "end", "text", "lyric")


def in_order(cues: DataFrame) -> DataFrame:
    """Inverted times swapped; a track whose cues all have times is sorted by them."""
    s, e = F.col("start"), F.col("end")
    swap = s > e
    rows = cues.withColumns({"start": F.when(swap, e).otherwise(s), "end": F.when(swap, s).otherwise(e)})
    timed = F.bool_and(F.col("start").isNotNull()).over(Window.partitionBy("track_id"))
    rows = rows.withColumn("_timed", timed)
    order = [F.when(F.col("_timed"), F.col("start")), F.when(F.col("_timed"), F.coalesce("end", "start")), F.col("seq")]
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy(*order)) - 1).drop("_timed")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files under ``path``."""
    files = checked(read_files(spark, path))
    return in_order(parse_vtt(files.where("ext in ('vtt', 'srt')")).unionByName(parse_ass(files.where("ext in ('ass', 'ssa')"))))


def _text(rows: DataFrame, piece: Column, head: str, order: str = "seq") -> DataFrame:
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy("track_id").agg(F.concat(F.regexp_replace(F.concat(F.lit(head), F.array_join(pieces, "\n")), r"(?U)\s+$", ""), F.lit("\n")).alias("text"))


def render_vtt(cues: DataFrame) -> DataFrame:
    """track_id, text: WebVTT; cues without times are plain text."""
    shown = lyric_display(F.col("text"), F.col("lyric"))
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    piece = F.concat(F.when(timed, F.concat(vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit("\n"))).otherwise(""), shown, F.lit("\n"))
    return _text(cues, piece, "WEBVTT\n\n")


def _timed(cues: DataFrame) -> DataFrame:
    rows = cues.where("start is not null and end is not null")
    return rows.withColumn("_no", F.row_number().over(Window.partitionBy("track_id").orderBy("seq")))


def render_srt(cues: DataFrame) -> DataFrame:
    """track_id, text: SRT of the timed cues, numbered."""
    shown = lyric_display(F.col("text"), F.col("lyric"))
    piece = F.concat(F.col("_no").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), shown, F.lit("\n"))
    return _text(_timed(cues), piece, "", "_no")


def ass_header(height: int = 1080, width: int = 1920, font: str = "Arial") -> str:
    """Script header with one style, its sizes in proportion to the picture's height."""
    scale = height / 1080
    # The style, and section, key and field names of the format.
    style = ["Default", font.replace(",", ""), round(72 * scale), "&H00FFFFFF", "&H000000FF", "&H00000000", "&H7F000000", 0, 0, 0, 0, 100, 100, 0, 0, 1]
    style += [round(3 * scale, 1), round(1.5 * scale, 1), 2, round(120 * scale), round(120 * scale), round(60 * scale), 1]
    info = ["[Script Info]", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.709", f"PlayResX: {width}", f"PlayResY: {height}", ""]
    styles = ["[V4+ Styles]", "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"]
    styles += ["Style: " + ",".join(map(str, style)), ""]
    return "\n".join([*info, *styles, "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", ""])


def ass_text(text: Column) -> Column:
    t = F.translate(text, "{}", "()")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)<i>", "{\\\\i1}"), "(?i)</i>", "{\\\\i0}")
    return F.replace(F.regexp_replace(t, r"</?[a-zA-Z][^>]*>", ""), F.lit("\n"), F.lit("\\N"))


def render_ass(cues: DataFrame, height: int = 1080) -> DataFrame:
    """track_id, text: ASS of the timed cues; lyrics in italics."""
    body = ass_text(lyric_display(F.col("text"), F.col("lyric")))
    body = F.when(F.coalesce("lyric", F.lit(False)), F.concat(F.lit("{\\i1}"), body, F.lit("{\\i0}"))).otherwise(body)
    piece = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), body)
    return _text(_timed(cues), piece, ass_header(height), "_no")


RENDERERS = {"vtt": render_vtt, "srt": render_srt, "ass": render_ass}


def export(cues: DataFrame, formats: list[str], source: str | None = None) -> dict[str, DataFrame]:
    """A table of texts per format, each asked for once; unknown formats and the source's own are errors."""
    wanted = list(dict.fromkeys(formats))
    if unknown := [f for f in wanted if f not in RENDERERS]:
        raise ValueError(f"unknown formats: {unknown}")
    if source in wanted:
        raise ValueError(f"already {source}")
    timed = cues.where("start is not null and end is not null")
    return {f: RENDERERS[f](timed) for f in wanted}


def write_texts(texts: DataFrame, path: str) -> None:
    """One row per track as Parquet; Spark's committer makes the write all or nothing."""
    texts.write.mode("overwrite").parquet(path)


def with_sound_tags(cues: DataFrame, events: DataFrame) -> DataFrame:
    """Dialogue and ``[tag]`` cues in time order; untimed cues last, dialogue before tags of the same start."""
    tags = events.select("track_id", F.lit(None).cast("long").alias("seq"), "start", "end", F.concat(F.lit("["), F.col("tag"), F.lit("]")).alias("text"), F.lit(False).alias("lyric"), F.lit(1).alias("_side"))
    rows = cues.select("track_id", F.col("seq").cast("long").alias("seq"), "start", "end", "text", "lyric", F.lit(0).alias("_side")).unionByName(tags)
    order = [F.col("start").asc_nulls_last(), F.col("_side"), F.col("seq"), F.col("end"), F.col("text")]
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy(*order)) - 1).drop("_side")


def pick_media(files: DataFrame) -> DataFrame:
    """Of the media files (path) that share a stem the one whose ending ranks first."""
    stem, ext = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.withColumn("stem", stem).withColumn("_rank", F.array_position(F.array(*map(F.lit, MEDIA_RANK)), ext)).where("_rank > 0")
    best = F.row_number().over(Window.partitionBy("stem").orderBy("_rank", "path"))
    return rows.withColumn("_r", best).where("_r = 1").select("stem", "path")


def language_of_path(path: Column) -> Column:
    """The tag before the ending, ``film.en.vtt`` gives ``en``; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z]{2,3})(?:[-_][A-Za-z]+)?\.[^./]+$", 1)), F.lit(""))


def shot_times(log: DataFrame) -> DataFrame:
    """Distinct cut times (track_id, t) from detector log lines (track_id, value)."""
    found = F.regexp_extract_all("value", F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return log.select("track_id", F.explode(found).alias("t")).select("track_id", F.col("t").cast("double").alias("t")).distinct()
