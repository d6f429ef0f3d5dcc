"""Timing of units and cues: gaps, repair of aligned units, durations, linger and chaining.

Rows are (track_id, seq, start, end, ...); seq is the order within a track. What reads only
neighbours is a window; what depends on its own earlier results is in ``folds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET_S, TRACK, interval_join, not_overlapping

TWO_FRAMES = 2.0 / 24.0
CHAIN_GAP_S = 0.5
LINGER_S = 1.0
HELD_GAP_S = 1.0
SPEAKABLE = r"[\p{L}\p{N}]"


def ordered() -> Window:
    return Window.partitionBy(TRACK).orderBy("seq")


def earlier() -> Window:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> Window:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def later() -> Window:
    return ordered().rowsBetween(1, Window.unboundedFollowing)


def shift(units: DataFrame, offset: Column) -> DataFrame:
    return units.withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset)


def crop_windows(spans: DataFrame, pad: float = 0.1) -> DataFrame:
    """Adds crop_start and crop_end: the span padded, not before 0, never empty; null stays null."""
    low, high = F.greatest(F.lit(0.0), F.col("start") - pad), F.col("end") + pad
    low = F.when(F.col("start").isNotNull(), low)
    return spans.withColumn("crop_start", low).withColumn("crop_end", F.when(high <= low, low + 0.1).otherwise(high))


def clamp_spans(spans: DataFrame, min_s: float = 0.05) -> DataFrame:
    return spans.withColumn("end", F.greatest("end", F.col("start") + min_s))


def min_length(spans: DataFrame, least_s: float) -> DataFrame:
    """Spans that last ``least_s`` or longer; those without times go."""
    return spans.where(F.col("end") - F.col("start") >= least_s)


def gaps(units: DataFrame) -> DataFrame:
    """Adds prev_end and gap_ms: the pause before each unit, null unless positive and known."""
    prev = F.lag("end").over(ordered())
    gap = (F.col("start") - F.col("prev_end")) * 1000.0
    return units.withColumn("prev_end", prev).withColumn("gap_ms", F.when(gap > 0, gap))


def break_flags(units: DataFrame, clause_ms: Column, skip_ms: Column, offline_ms: Column, speech: DataFrame | None = None, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``brk``: whether the pause before a unit separates cues.

    Without speech spans only pauses of ``offline_ms`` do. With them, pauses below
    ``clause_ms`` never do, those of ``skip_ms`` always, and those between only if no
    speech span overlaps them by more than 50 ms. An empty speech table is not the same as
    none: there every pause between is silent.
    """
    paused = gaps(units)
    gap = F.col("gap_ms")
    if speech is None:
        return paused.withColumn("brk", F.coalesce(gap >= offline_ms, F.lit(False)))
    doubtful = paused.where((gap >= clause_ms) & (gap < skip_ms)).select(TRACK, "seq", F.col("prev_end").alias("start"), F.col("start").alias("end"))
    silent = not_overlapping(doubtful, speech, 0.05, bucket_s).select(TRACK, "seq").withColumn("_silent", F.lit(True))
    out = paused.join(silent, [TRACK, "seq"], "left")
    return out.withColumn("brk", F.coalesce((gap >= skip_ms) | F.col("_silent"), F.lit(False))).drop("_silent")


def cue_numbers(units: DataFrame) -> DataFrame:
    """Adds ``cue``: the number of breaks up to and including the unit."""
    return units.withColumn("cue", F.sum(F.when(F.col("brk"), 1).otherwise(0)).over(so_far()))


def block_spans(units: DataFrame, block: str = "block") -> DataFrame:
    """First start and last end of each block's units; a block without times is null."""
    return units.groupBy(TRACK, block).agg(F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"))


def rescue_tiny(cues: DataFrame, trigger: float = 0.2, target: float = 0.5) -> DataFrame:
    """Cues shorter than ``trigger`` last until start + ``target``, over at most one following cue."""
    after, second = F.lead("start", 1).over(ordered()), F.lead("start", 2).over(ordered())
    want = F.col("start") + target
    free = after.isNull() | (want <= after)
    upto = F.when(free, want).otherwise(F.least(want, F.coalesce(second, F.lit(float("inf")))))
    return cues.withColumn("end", F.when(F.col("end") - F.col("start") < trigger, F.greatest("end", upto)).otherwise(F.col("end")))


def fill_inserted(spans: DataFrame, gap_s: float = 2.0, default_s: float = 2.0) -> DataFrame:
    """Times for rows without: an even share of the pause around them if that is short, else fixed steps."""
    known = F.col("start").isNotNull()
    run = F.sum(F.when(known, 1).otherwise(0)).over(so_far())
    rows = spans.withColumn("_known", known).withColumn("_run", run)
    rows = rows.withColumn("_prev", F.last(F.when(F.col("_known"), F.col("end")), ignorenulls=True).over(earlier()))
    rows = rows.withColumn("_next", F.first(F.when(F.col("_known"), F.col("start")), ignorenulls=True).over(later()))
    within = Window.partitionBy(TRACK, "_run", "_known")
    rows = rows.withColumn("_k", (F.row_number().over(within.orderBy("seq")) - 1).cast("double")).withColumn("_n", F.count(F.lit(1)).over(within))
    near = (F.col("_next") - F.col("_prev") <= gap_s) & (F.col("_next") > F.col("_prev"))
    step = (F.col("_next") - F.col("_prev")) / (F.col("_n") + 1)
    base = F.when(F.col("_prev").isNotNull(), F.col("_prev")).when(F.col("_next").isNotNull(), F.greatest(F.lit(0.0), F.col("_next") - F.col("_n") * default_s)).otherwise(0.0)
    share = F.coalesce(near, F.lit(False))
    first = F.when(share, F.col("_prev") + step * (F.col("_k") + 1)).otherwise(base + F.col("_k") * default_s)
    second = F.when(share, first + step).otherwise(base + (F.col("_k") + 1) * default_s)
    rows = rows.withColumn("start", F.when(F.col("_known"), F.col("start")).otherwise(first)).withColumn("end", F.when(F.col("_known"), F.col("end")).otherwise(second))
    return rows.select(spans.columns)


def interpolate_missing(units: DataFrame) -> DataFrame:
    """Units without positive duration take times by index between timed neighbours, to the millisecond."""
    timed = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    rows = units.withColumn("_i", F.row_number().over(ordered())).withColumn("_ok", timed)
    anchor = F.when(F.col("_ok"), F.struct("_i", "start", "end"))
    rows = rows.withColumn("_p", F.last(anchor, ignorenulls=True).over(earlier())).withColumn("_q", F.first(anchor, ignorenulls=True).over(later()))
    p, q = F.col("_p"), F.col("_q")
    part = (F.col("_i") - p["_i"]) / (q["_i"] - p["_i"])

    def between(side: str) -> Column:
        inner = p[side] + (q[side] - p[side]) * part
        return F.bround(F.when(p.isNotNull() & q.isNotNull(), inner).otherwise(F.coalesce(p[side], q[side])), 3)

    fixed = {s: F.when(F.col("_ok"), F.col(s)).otherwise(between(s)) for s in ("start", "end")}
    return rows.withColumns(fixed).select(units.columns)


def _spread(rows: DataFrame, low: Column, high: Column, apply: Column) -> DataFrame:
    """Spreads the speakable units of each run (_run) evenly over [low, high]; the rest of the run keeps to its edges."""
    w = Window.partitionBy(TRACK, "_run")
    speak = F.col("text").rlike(SPEAKABLE)
    rows = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_move", F.coalesce(apply, F.lit(False))).withColumn("_speak", speak)
    rows = rows.withColumn("_m", F.count_if("_speak").over(w))
    rows = rows.withColumn("_r", F.count_if("_speak").over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    step = (F.col("_high") - F.col("_low")) / F.col("_m")
    return rows.withColumn("_s", F.col("_low") + step * F.col("_r")).withColumn("_e", F.col("_low") + step * (F.col("_r") + 1))


def relocate_zero_runs(units: DataFrame, speech: DataFrame, eps: float = 0.05, max_run: int = 8, bucket_s: float = BUCKET_S) -> DataFrame:
    """Runs of units without duration move to the speech span inside the pause around them that is nearest to where they lie.

    Only speakable units spread over the span; marks after them follow, marks before stay.
    Runs longer than ``max_run`` and runs without such a span stay.
    """
    flat = F.col("end") - F.col("start") <= eps
    rows = units.withColumn("_flat", flat)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_flat"), 0).otherwise(1)).over(so_far()))
    rows = rows.withColumn("_prev", F.coalesce(F.last(F.when(~F.col("_flat"), F.col("end")), ignorenulls=True).over(earlier()), F.lit(0.0)))
    rows = rows.withColumn("_next", F.coalesce(F.first(F.when(~F.col("_flat"), F.col("start")), ignorenulls=True).over(later()), F.lit(1e12)))
    runs = rows.where("_flat").groupBy(TRACK, "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.count_if(F.col("text").rlike(SPEAKABLE)).alias("_alnum"), F.min_by("start", "seq").alias("_at"), F.first("_prev").alias("_p"), F.first("_next").alias("_n")
    )
    runs = runs.where((F.col("_len") <= max_run) & (F.col("_alnum") > 0))
    # a candidate lies wholly in the pause; at the end of a track the pause is open
    segments = speech.where(F.col("end") - F.col("start") > eps).groupBy(TRACK).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_segs"))
    fit = F.filter("_segs", lambda s: (s["start"] >= F.col("_p") - eps) & (s["end"] <= F.col("_n") + eps))
    best = F.array_min(F.transform(fit, lambda s: F.struct(F.abs(s["start"] - F.col("_at")).alias("d"), s["start"].alias("s"), s["end"].alias("e"))))
    runs = runs.join(segments, TRACK).withColumn("_best", best).where("_best is not null")
    runs = runs.select(TRACK, "_run", F.lit(True).alias("_hit"), F.greatest("_p", F.col("_best")["s"]).alias("_lo"), F.least("_n", F.col("_best")["e"]).alias("_hi"))
    rows = rows.join(runs.where(F.col("_hi") - F.col("_lo") > eps), [TRACK, "_run"], "left").withColumn("_run", F.when(F.col("_flat"), F.col("_run")).otherwise(-F.col("_run") - 1))
    rows = _spread(rows, F.col("_lo"), F.col("_hi"), F.col("_flat") & F.col("_hit"))
    trailing = F.col("_move") & ~F.col("_speak") & (F.col("_r") == F.col("_m"))
    moves = F.col("_move") & F.col("_speak")
    start = F.when(moves, F.col("_s")).when(trailing, F.col("_high")).otherwise(F.col("start"))
    end = F.when(moves, F.col("_e")).when(trailing, F.col("_high")).otherwise(F.col("end"))
    return rows.withColumns({"start": start, "end": end}).select(units.columns)


def pull_stranded_runs(units: DataFrame, speech: DataFrame, tol: float = 0.5, eps: float = 0.05, bucket_s: float = BUCKET_S) -> DataFrame:
    """Runs of units in silence move to the nearest speech edge within ``tol``; farther ones stay."""
    speech = speech.where("end > start").select(TRACK, "start", "end")
    long = interval_join(units.where("end > start").select(TRACK, "seq", "start", "end"), speech, bucket_s=bucket_s)
    point = interval_join(units.where("end = start").select(TRACK, "seq", "start", "end"), speech, how="closed", bucket_s=bucket_s)
    heard = long.select(TRACK, "seq").union(point.select(TRACK, "seq")).distinct().withColumn("_in", F.lit(True))
    rows = units.join(heard, [TRACK, "seq"], "left").withColumn("_out", F.col("_in").isNull())
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_out"), 0).otherwise(1)).over(so_far()))
    rows = rows.withColumn("_prev", F.coalesce(F.last(F.when(~F.col("_out"), F.col("end")), ignorenulls=True).over(earlier()), F.lit(0.0)))
    rows = rows.withColumn("_next", F.coalesce(F.first(F.when(~F.col("_out"), F.col("start")), ignorenulls=True).over(later()), F.lit(float("inf"))))
    runs = rows.where("_out").groupBy(TRACK, "_run").agg(
        F.min_by("start", "seq").alias("_rs"), F.max_by("end", "seq").alias("_re"), F.count_if(F.col("text").rlike(SPEAKABLE)).alias("_alnum"), F.first("_prev").alias("_p"), F.first("_next").alias("_n")
    )
    edges = speech.groupBy(TRACK).agg(F.array_sort(F.collect_list("end")).alias("_ends"), F.array_sort(F.collect_list("start")).alias("_starts"))
    runs = runs.join(edges, TRACK).where("_alnum > 0")
    left = F.coalesce(F.array_max(F.filter("_ends", lambda e: e <= F.col("_rs") + eps)), F.lit(float("-inf")))
    right = F.coalesce(F.array_min(F.filter("_starts", lambda s: s >= F.col("_re") - eps)), F.lit(float("inf")))
    runs = runs.withColumn("_left", left).withColumn("_right", right)
    to_left, to_right = F.col("_rs") - F.col("_left"), F.col("_right") - F.col("_re")
    width = F.greatest(F.col("_re") - F.col("_rs"), F.col("_alnum") * eps)
    back = to_left <= to_right
    high_back = F.least("_left", "_next_")
    runs = runs.withColumn("_next_", F.col("_n")).where(F.least(to_left, to_right) <= tol)
    low = F.when(back, F.greatest(F.col("_p"), high_back - width)).otherwise(F.greatest("_p", "_right"))
    runs = runs.withColumn("_lo", low).withColumn("_hi", F.when(back, high_back).otherwise(F.least(F.col("_next_"), F.col("_lo") + width)))
    runs = runs.where("_hi > _lo").select(TRACK, "_run", F.lit(True).alias("_hit"), "_lo", "_hi")
    rows = rows.join(runs, [TRACK, "_run"], "left").withColumn("_run", F.when(F.col("_out"), F.col("_run")).otherwise(-F.col("_run") - 1))
    rows = _spread(rows, F.col("_lo"), F.col("_hi"), F.col("_out") & F.col("_hit"))
    moves = F.col("_move") & F.col("_speak")
    lead, trail = F.col("_move") & ~F.col("_speak") & (F.col("_r") == 0), F.col("_move") & ~F.col("_speak") & (F.col("_r") == F.col("_m"))
    start = F.when(moves, F.col("_s")).when(lead, F.col("_low")).when(trail, F.col("_high")).otherwise(F.col("start"))
    end = F.when(moves, F.col("_e")).when(lead, F.col("_low")).when(trail, F.col("_high")).otherwise(F.col("end"))
    return rows.withColumns({"start": start, "end": end}).select(units.columns)


def carve_silence(units: DataFrame, speech: DataFrame, min_overhang: float = 0.2, bucket_s: float = BUCKET_S) -> DataFrame:
    """Units shrink to the speech they overlap where more than ``min_overhang`` sticks out on a side."""
    hit = interval_join(units.where("end > start").select(TRACK, "seq", "start", "end"), speech.select(TRACK, "start", "end"), bucket_s=bucket_s)
    inner = hit.groupBy(TRACK, "seq").agg(F.min(F.greatest("start", "r_start")).alias("_a"), F.max(F.least("end", "r_end")).alias("_b"))
    rows = units.join(inner, [TRACK, "seq"], "left")
    start = F.when(F.col("_a") - F.col("start") > min_overhang, F.col("_a")).otherwise(F.col("start"))
    end = F.when(F.col("end") - F.col("_b") > min_overhang, F.col("_b")).otherwise(F.col("end"))
    return rows.withColumns({"start": start, "end": end}).select(units.columns)


def position_with_speech(units: DataFrame, speech: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Relocation, pulling and carving in this order."""
    units = relocate_zero_runs(units, speech, bucket_s=bucket_s)
    return carve_silence(pull_stranded_runs(units, speech, bucket_s=bucket_s), speech, bucket_s=bucket_s)


def _held_end(words: Column, cap: Column) -> Column:
    """End of the last word before the first long silence at or after ``cap``; words are (start, end), timed ones only."""
    timed = F.array_sort(F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull()))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.lit(False).alias("stop"))

    def step(acc: Column, w: Column) -> Column:
        stop = acc["stop"] | F.coalesce((w["start"] - acc["end"] > HELD_GAP_S) & (w["start"] >= cap), F.lit(False))
        return F.struct(F.when(stop, acc["end"]).otherwise(w["end"]).alias("end"), stop.alias("stop"))

    return F.aggregate(timed, start, step)["end"]


def polish_timing(cues: DataFrame, min_cue_s: Column, max_cue_s: Column, cps: Column, lag_out_s: Column, reading: Column) -> DataFrame:
    """Linger, tail pad, chaining to two frames and the duration cap; text is never touched.

    A cue wants the longest of its own duration, ``min_cue_s``, its tail pad and its
    reading time (at most a second more), and gets it up to the next start, unless no more
    than two frames are left. Pauses under half a second close to two frames. Cues beyond
    ``max_cue_s`` end there, unless words of an unbroken stretch still sound. Applied twice
    it changes nothing more. Cues have (track_id, seq, start, end) and word_data, an array
    of (start, end).
    """
    after = F.lead("start").over(ordered())
    dur = F.col("end") - F.col("start")
    wish = F.greatest(
        dur,
        F.when(min_cue_s > 0, min_cue_s).otherwise(dur),
        F.when(lag_out_s > 0, dur + lag_out_s).otherwise(dur),
        F.when(cps > 0, F.least(reading / cps, dur + LINGER_S)).otherwise(dur),
    )
    rows = cues.withColumn("_next", after).withColumn("_want", F.col("start") + wish)
    longer = wish > dur
    end = (
        F.when(longer & F.col("_next").isNull(), F.col("_want"))
        .when(longer & (F.col("_next") - F.col("end") > TWO_FRAMES), F.least("_want", "_next"))
        .otherwise(F.col("end"))
    )
    rows = rows.withColumn("_end", end)
    gap = F.col("_next") - F.col("_end")
    chained = F.when((gap >= 0) & (gap < CHAIN_GAP_S) & (gap > TWO_FRAMES), F.col("_next") - TWO_FRAMES).otherwise(F.col("_end"))
    rows = rows.withColumn("_end", chained).withColumn("_cap", F.col("start") + max_cue_s)
    last = F.array_max(F.transform(F.filter("word_data", lambda w: w["start"].isNotNull() & w["end"].isNotNull()), lambda w: w["end"]))
    held = _held_end(F.col("word_data"), F.col("_cap"))
    stays = F.greatest(F.col("_cap"), F.least(held, F.coalesce(F.col("_next"), held)))
    over = (max_cue_s > 0) & (F.col("_end") - F.col("start") > max_cue_s)
    final = F.when(over, F.when(last > F.col("_cap"), stays).otherwise(F.col("_cap"))).otherwise(F.col("_end"))
    return rows.withColumn("end", final).select(cues.columns)


def trim_overlaps(cues: DataFrame, order: tuple[str, ...] = ("start", "end", "seq")) -> DataFrame:
    """Sorted by time, every cue ends no later than the next begins."""
    after = F.lead("start").over(Window.partitionBy(TRACK).orderBy(*order))
    return cues.withColumn("end", F.least("end", F.coalesce(after, F.col("end"))))


