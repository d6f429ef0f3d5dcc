"""Edits and translations of cues: payloads, answers, gates, and what is missing."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.layout import wrapped as laid_out
from ..functions.text import dash_parts, is_dash_cue, lyric_display, one_line, strip_for_translation
from .intervals import TRACK
from .stretches import computed

#: The second half of a two-speaker cue is asked for under its index plus this.
SECOND_HALF = 1_000_000
#: Gates of a fix: growth, and likeness from this length on.
GROWTH, SLACK, LIKENESS_FROM, LEAST_LIKENESS = 1.5, 8, 12, 0.4


def flat(s: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def payload(cues: DataFrame) -> DataFrame:
    """track_id, i, t and, for two-speaker cues, parts. Cues have (track_id, seq, text, lyric)."""
    dual = ~F.coalesce("lyric", F.lit(False)) & is_dash_cue(F.col("text"))
    return cues.select(TRACK, F.col("seq").alias("i"), F.trim(F.regexp_replace("text", "\n", " ")).alias("t"), F.when(dual, dash_parts(F.col("text"))).alias("parts"))


def speaker_units(items: DataFrame) -> DataFrame:
    """One row (track_id, i, t) per speaker: the second half of a dual cue has its own index."""
    halves = F.when(
        F.col("parts").isNotNull(),
        F.array(F.struct(F.col("i").cast("long").alias("i"), F.col("parts")[0].alias("t")), F.struct((F.col("i") + SECOND_HALF).cast("long").alias("i"), F.col("parts")[1].alias("t"))),
    ).otherwise(F.array(F.struct(F.col("i").cast("long").alias("i"), F.col("t").alias("t"))))
    return items.select(TRACK, F.explode(halves).alias("u")).select(TRACK, "u.i", "u.t")


def collapse_units(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (track_id, i, t) per speaker back to cues; a dual cue only if both halves came."""
    keyed = answers.select(TRACK, (F.col("i") % SECOND_HALF).alias("i"), F.when(F.col("i") >= SECOND_HALF, 1).otherwise(0).alias("half"), "t")
    sides = keyed.groupBy(TRACK, "i").agg(F.max(F.when(F.col("half") == 0, F.col("t"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("t"))).alias("b"))
    rows = items.join(sides, [TRACK, "i"])
    a, b = one_line(F.coalesce("a", F.lit(""))), one_line(F.coalesce("b", F.lit("")))
    both = F.when((a != "") & (b != ""), F.concat(a, F.lit("\n"), b))
    return rows.select(TRACK, "i", F.when(F.col("parts").isNotNull(), both).otherwise(F.col("a")).alias("t")).where("t is not null")


def last_answer(answers: DataFrame) -> DataFrame:
    """Of repeated answers (track_id, seq, i, t) to a cue the last stands."""
    return answers.groupBy(TRACK, "i").agg(F.max_by("t", "seq").alias("t"))


def missing_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Cues without an answer, or with a blank one."""
    given = answers.where(F.trim(F.coalesce("t", F.lit(""))) != "").select(TRACK, "i")
    return items.select(TRACK, "i").join(given, [TRACK, "i"], "left_anti")


def translated_cues(cues: DataFrame, answers: DataFrame, lang: str | None, wrapped: bool = True) -> DataFrame:
    """Cues with their translation laid out for ``lang``; without one the source text stays."""
    rows = cues.join(answers.select(TRACK, F.col("i").alias("seq"), F.col("t").alias("_t")), [TRACK, "seq"], "left")
    lyric = F.coalesce("lyric", F.lit(False))
    dual, said = F.coalesce(~lyric & is_dash_cue(F.col("text")), F.lit(False)), F.coalesce(F.nullif(F.trim("_t"), F.lit("")), "text")
    rows = computed(rows.withColumns({"_dual": dual, "_said": said}))
    rows = computed(rows.withColumn("_plain", F.when(~F.col("_dual"), strip_for_translation(F.col("_said")))))
    plain = F.col("_plain")
    if wrapped and lang:
        plain = laid_out(plain, F.lit(lang), F.lit(2))
    source, halves = dash_parts(F.col("text")), F.split(F.coalesce("_t", F.lit("")), "\n")
    half = lambda k: F.concat(F.lit("-"), strip_for_translation(F.coalesce(F.nullif(one_line(F.get(halves, F.lit(k))), F.lit("")), F.get(source, F.lit(k)))))
    out = F.when(F.col("_dual"), F.concat(half(0), F.lit("\n"), half(1))).otherwise(lyric_display(plain, lyric))
    return rows.withColumn("text", out).select(cues.columns)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity ratio of two texts by matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def gate_fixes(cues: DataFrame, fixes: DataFrame) -> DataFrame:
    """Adds ``why`` to fixes (track_id, seq, i, orig, fixed): the first reason to reject, null if it holds.

    Reasons: index out of range, misquote, no-op, empty, expansion, rewrite.
    """
    known = cues.select(TRACK, F.col("seq").alias("i"), flat(F.col("text")).alias("_now"))
    rows = fixes.join(known, [TRACK, "i"], "left").withColumn("_new", flat(F.col("fixed")))
    now, new = F.col("_now"), F.col("_new")
    early = (
        F.when(now.isNull(), "index out of range")
        .when(flat(F.col("orig")) != now, "misquote")
        .when(new == now, "no-op")
        .when(new == "", "empty")
        .when(F.length(new) > GROWTH * F.length(now) + SLACK, "expansion")
    )
    rows = rows.withColumn("_why", early)
    # the costly comparison runs only where no cheaper gate has decided
    judged = F.col("_why").isNull() & (F.length(now) >= LIKENESS_FROM)
    ratio = likeness(F.when(judged, now), F.when(judged, new))
    return rows.withColumn("why", F.when(judged & (ratio < LEAST_LIKENESS), "rewrite").otherwise(F.col("_why"))).drop("_now", "_new", "_why")


def apply_fixes(cues: DataFrame, gated: DataFrame) -> DataFrame:
    """Cues with the last accepted fix of each."""
    last = gated.where("why is null").groupBy(TRACK, "i").agg(F.max_by("fixed", "seq").alias("_fixed")).withColumnRenamed("i", "seq")
    return cues.join(last, [TRACK, "seq"], "left").withColumn("text", F.coalesce("_fixed", "text")).select(cues.columns)


def salvage(raw: Column, schema: str) -> Column:
    """The first JSON object in a text with anything around it; null fields if there is none."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)


def parse_translations(replies: DataFrame) -> DataFrame:
    """Rows (track_id, seq, i, t) from replies (track_id, raw); malformed items go."""
    items = salvage(F.col("raw"), "translations array<struct<i:string,t:string>>")["translations"]
    rows = replies.select(TRACK, F.posexplode(items).alias("seq", "x")).select(TRACK, "seq", F.expr("try_cast(x.i as int)").alias("i"), F.col("x.t").alias("t"))
    return rows.where("i is not null and t is not null")


def parse_fixes(replies: DataFrame) -> DataFrame:
    """Rows (track_id, seq, i, orig, fixed, reason) from replies (track_id, raw)."""
    items = salvage(F.col("raw"), "fixes array<struct<i:string,orig:string,fixed:string,reason:string>>")["fixes"]
    field = lambda n: F.coalesce(F.col(f"x.{n}"), F.lit("")).alias(n)
    rows = replies.select(TRACK, F.posexplode(items).alias("seq", "x")).select(TRACK, "seq", F.expr("try_cast(x.i as int)").alias("i"), field("orig"), field("fixed"), field("reason"))
    return rows.where("i is not null")


def context_tail(cues: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` cues of each track."""
    rank = F.row_number().over(Window.partitionBy(TRACK).orderBy(F.desc("seq")))
    return cues.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
