"""Aggregates over tracks: votes, adaptive thresholds, cue metrics, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import reconcile, spaced, to_code
from ..functions.text import content_mass, line_end_penalty, once, spaced_tokens
from .intervals import TRACK
from .stretches import computed
from .timing import ordered, so_far


def vote_language(chunks: DataFrame, default: str | None = "english") -> DataFrame:
    """track_id, lang: the language with most letters and digits among a track's chunks (seq, detected, text).

    Of equal ones the first met wins. Tracks without any mass get ``default``.
    """
    key = once(reconcile(F.col("detected"), F.col("text")), lambda name: F.coalesce(to_code(name), F.lower(F.trim(name))))
    rows = computed(chunks.select(TRACK, "seq", key.alias("lang"), content_mass(F.col("text")).alias("mass")))
    sums = rows.where("lang is not null and mass > 0").groupBy(TRACK, "lang").agg(F.sum("mass").alias("mass"), F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy(TRACK).orderBy(F.desc("mass"), "seq"))
    best = sums.withColumn("_r", rank).where("_r = 1").select(TRACK, "lang")
    return chunks.select(TRACK).distinct().join(best, TRACK, "left").withColumn("lang", F.coalesce("lang", F.lit(default)))


def adaptive_clause_ms(paused: DataFrame, low: int = 300, high: int = 800, least: int = 50, share: float = 0.9, margin: float = 1.15) -> DataFrame:
    """track_id, clause_ms: the 90th percentile of pauses (gap_ms) under two seconds, times a margin, clamped.

    Null for tracks with fewer than ``least`` such pauses.
    """
    short = F.when((F.col("gap_ms") > 0) & (F.col("gap_ms") < 2000), F.col("gap_ms"))
    found = paused.groupBy(TRACK).agg(F.count(short).alias("_n"), F.percentile(short, share).alias("_p"))
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.round(F.col("_p") * margin, 6)).cast("int")))
    return found.select(TRACK, F.when(F.col("_n") >= least, value).alias("clause_ms"))


def rescale_thresholds(policy: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Policy rows (track_id, clause_ms, offline_ms) with the adaptive clause, offline kept in proportion."""
    rows = policy.join(adaptive.withColumnRenamed("clause_ms", "_a"), TRACK, "left")
    offline = F.bround(F.col("_a") * (F.col("offline_ms") / F.col("clause_ms"))).cast("int")
    rows = rows.withColumn("offline_ms", F.coalesce(offline, "offline_ms"))
    return rows.withColumn("clause_ms", F.coalesce("_a", "clause_ms")).drop("_a")


def tail_token(text: Column, lang: Column) -> Column:
    """Last word of a cue; of unspaced languages its last character."""
    last = F.element_at(F.concat(F.array(F.lit("")), spaced_tokens(F.regexp_replace(text, "\n", " "))), -1)
    return F.when(spaced(lang), last).otherwise(F.right(last, F.lit(1)))


def cue_metrics(cues: DataFrame, by: list[str]) -> DataFrame:
    """Durations, reading speeds and bad line ends of cues (track_id, seq, start, end, text, lang), one row per ``by``."""
    dur = F.col("end") - F.col("start")
    chars = F.length(F.regexp_replace("text", "[ \n]", ""))
    last = F.lead("seq").over(ordered()).isNull()
    bad = line_end_penalty(F.col("_tail"), F.col("lang")) >= 2
    rows = cues.withColumn("_d", dur).withColumn("_cps", F.when(dur > 0, chars / dur)).withColumn("_last", last).withColumn("_tail", tail_token(F.col("text"), F.col("lang")))
    rows = computed(rows.select(*by, *{"lang"}.difference(by), "_d", "_cps", "_last", "_tail")).withColumn("_bad", F.when(~F.col("_last"), F.when(bad, 1.0).otherwise(0.0)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("_d", 0.5).alias("dur_med"),
        F.percentile("_d", 0.9).alias("dur_p90"),
        F.max("_d").alias("dur_max"),
        F.count_if(F.col("_d") > 7.0).alias("over7s"),
        F.count_if(F.col("_d") < 0.5).alias("under05s"),
        F.count_if(F.col("_d") < 5.0 / 6.0).alias("under_min"),
        F.coalesce(F.percentile("_cps", 0.5), F.lit(0.0)).alias("cps_med"),
        F.coalesce(F.percentile("_cps", 0.9), F.lit(0.0)).alias("cps_p90"),
        F.avg("_bad").alias("bad_end"),
    )


def mid_phrase_cuts(cues: DataFrame, phrases: DataFrame, offline_s: float) -> DataFrame:
    """Per track, how many inner cue boundaries fall inside a phrase, by kind of boundary.

    Cues have (track_id, seq, start, end, text); ``phrases`` gives the phrase starts as
    offsets (track_id, offset) into the track's text without blanks. A boundary with a
    pause of ``offline_s`` is a pause break, any other a length break.
    """
    chars = F.length(F.regexp_replace("text", "[ \n]", ""))
    rows = cues.withColumn("offset", F.sum(chars).over(so_far())).withColumn("_gap", F.lead("start").over(ordered()) - F.col("end"))
    rows = rows.where(F.col("_gap").isNotNull()).join(phrases.select(TRACK, "offset").distinct().withColumn("_whole", F.lit(True)), [TRACK, "offset"], "left")
    paused, mid = F.col("_gap") >= offline_s, F.col("_whole").isNull()
    out = rows.groupBy(TRACK).agg(
        F.count_if(~paused).alias("n_len"), F.count_if(paused).alias("n_gap"), F.count_if(~paused & mid).alias("n_len_mid"), F.count_if(paused & mid).alias("n_gap_mid")
    )
    share = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    return out.withColumns(
        {
            "len_mid_pct": share(F.col("n_len_mid"), F.col("n_len")),
            "gap_mid_pct": share(F.col("n_gap_mid"), F.col("n_gap")),
            "mid_rate": (F.col("n_len_mid") + F.col("n_gap_mid")) / (F.col("n_len") + F.col("n_gap")),
        }
    )


def path_quality(edges: DataFrame) -> DataFrame:
    """Per track the span-weighted mean and the least quality of its path (src, dst, quality)."""
    w = F.col("dst") - F.col("src")
    return edges.groupBy(TRACK).agg((F.sum(F.col("quality") * w) / F.sum(w)).alias("average"), F.min("quality").alias("worst"))


def spoken_time(units: DataFrame, by: list[str]) -> DataFrame:
    """Summed positive durations."""
    return units.groupBy(*by).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("spoken_s"))


def payload_signature(payload: DataFrame) -> DataFrame:
    """track_id, signature: SHA-1 over the track's items (i, t) in order, as JSON."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: F.to_json(x))
    return payload.groupBy(TRACK).agg(F.sha1(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).cast("binary")).alias("signature"))
