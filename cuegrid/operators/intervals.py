"""Interval algebra over the spans of many tracks.

Spans have track_id, start and end in seconds; a side that must be told apart row by row
also has seq. Everything is windows, equi-joins on (track_id, time bucket) and
aggregations, so a track is never collected and no join is without an equi key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = "track_id"
#: Width of a join bucket in seconds, near the length of usual spans.
BUCKET_S = 30.0
MOST_TAGS = 10_000


def _before(*order: str, keys: tuple[str, ...] = (TRACK,)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(*order: str, keys: tuple[str, ...] = (TRACK,)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the overlap; negative if the spans are apart."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def interval_join(left: DataFrame, right: DataFrame, residual: Column | None = None, how: str = "strict", bucket_s: float = BUCKET_S) -> DataFrame:
    """Pairs of left and right rows of a track whose spans overlap.

    Right columns come with the prefix ``r_``. ``how``: ``strict`` asks for a common
    stretch of time, ``closed`` for a common point. Both sides are spread over the time
    buckets they touch; a pair is kept in the bucket where its overlap begins, so pairs
    need no deduplication. A null bound joins with nothing.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(s / bucket_s), F.floor(e / bucket_s)))
    a = left.where("start <= end").withColumn("_b", bucket(F.col("start"), F.col("end")))
    b = right.where("start <= end").select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("_rb", bucket(F.col("r_start"), F.col("r_end")))
    first = F.floor(F.greatest("start", "r_start") / bucket_s)
    length = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    on = (F.col(TRACK) == F.col(f"r_{TRACK}")) & (F.col("_b") == F.col("_rb")) & (F.col("_b") == first)
    on = on & (length > 0 if how == "strict" else length >= 0)
    if residual is not None:
        on = on & residual
    return a.join(b, on).drop("_b", "_rb", f"r_{TRACK}")


def overlapping(left: DataFrame, right: DataFrame, min_overlap: float = 0.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """Semi-join: left rows (with seq) that overlap a right span by more than ``min_overlap`` seconds."""
    length = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    hit = interval_join(left.select(TRACK, "seq", "start", "end"), right.select(TRACK, "start", "end"), length > min_overlap, bucket_s=bucket_s)
    return left.join(hit.select(TRACK, "seq").distinct(), [TRACK, "seq"], "left_semi")


def not_overlapping(left: DataFrame, right: DataFrame, min_overlap: float = 0.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """Anti-join: left rows (with seq) that no right span overlaps by more than ``min_overlap`` seconds."""
    hit = overlapping(left.select(TRACK, "seq", "start", "end"), right, min_overlap, bucket_s)
    return left.join(hit.select(TRACK, "seq"), [TRACK, "seq"], "left_anti")


def within_spans(points: DataFrame, spans: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Points (track_id, t) that lie in a half-open span."""
    at = points.withColumn("start", F.col("t")).withColumn("end", F.col("t")).withColumn("seq", F.col("t"))
    hit = interval_join(at.select(TRACK, "seq", "start", "end"), spans.select(TRACK, "start", "end"), F.col("start") < F.col("r_end"), "closed", bucket_s)
    return points.join(hit.select(TRACK, F.col("seq").alias("t")).distinct(), [TRACK, "t"], "left_semi")


def flagged_windows_to_spans(windows: DataFrame, width: float = 2.0, gap: float = 2.0, min_span: float = 3.0) -> DataFrame:
    """Spans of flagged windows (track_id, t, flag): windows at most ``gap`` apart merge, short spans go."""
    w = Window.partitionBy(TRACK).orderBy("t")
    hit = windows.where("flag").withColumn("_end", F.lag(F.col("t") + width).over(w))
    hit = hit.withColumn("_isle", F.sum(F.when(F.col("t") - F.col("_end") <= gap, 0).otherwise(1)).over(_upto("t")))
    spans = hit.groupBy(TRACK, "_isle").agg(F.min("t").alias("start"), (F.max("t") + width).alias("end"))
    return spans.where(F.col("end") - F.col("start") >= min_span).select(TRACK, "start", "end")


def coalesce_spans(spans: DataFrame, keys: tuple[str, ...] = (TRACK,)) -> DataFrame:
    """Union of a track's spans: overlapping or touching ones become one."""
    reach = F.max("end").over(_before("start", "end", keys=keys))
    isle = F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(_upto("start", "end", keys=keys))
    marked = spans.withColumn("_reach", reach).withColumn("_isle", isle)
    return marked.groupBy(*keys, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")


def silence_gaps(spans: DataFrame, audio_end: DataFrame | None = None) -> DataFrame:
    """Complement of a track's spans from 0 on, up to ``audio_end`` (track_id, audio_end) where given."""
    prev = F.coalesce(F.max("end").over(_before("start", "end")), F.lit(0.0))
    prev = F.greatest(prev, F.lit(0.0))
    inner = spans.withColumn("_prev", prev).where("start > _prev").select(TRACK, F.col("_prev").alias("start"), F.col("start").alias("end"))
    if audio_end is None:
        return inner
    last = spans.groupBy(TRACK).agg(F.greatest(F.max("end"), F.lit(0.0)).alias("start"))
    tail = audio_end.join(last, TRACK, "left").select(TRACK, F.coalesce("start", F.lit(0.0)).alias("start"), F.col("audio_end").alias("end"))
    return inner.unionByName(tail.where("end > start"))


def subtract_spans(spans: DataFrame, cover: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Pieces of each span (with seq) that no ``cover`` span touches; other columns are kept."""
    key = (TRACK, "seq")
    hit = interval_join(spans.select(*key, "start", "end"), cover.select(TRACK, "start", "end"), bucket_s=bucket_s)
    before = F.greatest("start", F.coalesce(F.max("r_end").over(_before("r_start", "r_end", keys=key)), F.col("start")))
    holes = hit.withColumn("_from", before).where("r_start > _from").select(*key, F.col("_from").alias("start"), F.col("r_start").alias("end"))
    last = hit.groupBy(*key).agg(F.max("r_end").alias("_last"))
    tail = spans.select(*key, "start", "end").join(last, list(key), "left")
    tail = tail.select(*key, F.greatest("start", F.coalesce("_last", "start")).alias("start"), "end").where("start < end")
    pieces = holes.unionByName(tail)
    rest = [c for c in spans.columns if c not in ("start", "end", *key)]
    return pieces.join(spans.select(*key, *rest), list(key)).select(*spans.columns) if rest else pieces.select(*spans.columns)


def snap_to_silence(points: DataFrame, silences: DataFrame, snap_s: float = 1.5, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``snapped`` to points (track_id, seq, t): into the nearest silence in reach, else unchanged.

    A point in a silence stays. Otherwise each silence offers its midpoint, pulled into the
    reach; an offer outside its silence does not count; of equally near ones the first
    silence wins.
    """
    reach = points.select(TRACK, "seq", "t", (F.col("t") - snap_s).alias("start"), (F.col("t") + snap_s).alias("end"))
    near = interval_join(reach, silences.select(TRACK, "start", "end"), how="closed", bucket_s=bucket_s)
    offer = F.least(F.greatest((F.col("r_start") + F.col("r_end")) / 2, F.col("start")), F.col("end"))
    near = near.withColumn("_p", offer).withColumn("_in", F.col("t").between(F.col("r_start"), F.col("r_end")))
    near = near.where(F.col("_in") | F.col("_p").between(F.col("r_start"), F.col("r_end")))
    best = near.groupBy(TRACK, "seq").agg(
        F.bool_or("_in").alias("_in"),
        F.min(F.struct(F.abs(F.col("_p") - F.col("t")).alias("d"), F.col("r_start"), F.col("r_end"), F.col("_p").alias("p")))["p"].alias("_p"),
    )
    out = points.join(best, [TRACK, "seq"], "left")
    return out.withColumn("snapped", F.when(F.coalesce("_in", F.lit(False)), F.col("t")).otherwise(F.coalesce("_p", "t"))).drop("_in", "_p")


def excise_spans(segments: DataFrame, spans: DataFrame, silences: DataFrame, snap_s: float = 1.5, min_keep_s: float = 0.4, bucket_s: float = BUCKET_S) -> tuple[DataFrame, DataFrame]:
    """(kept pieces of the segments, spans actually cut): cut points snap into silences first.

    A track without segments keeps its spans as they are, unsnapped.
    """
    numbered = spans.withColumn("_n", F.row_number().over(Window.partitionBy(TRACK).orderBy("start", "end")))
    ends = numbered.select(TRACK, F.concat("_n", F.lit(":a")).alias("seq"), F.col("start").alias("t")).unionByName(numbered.select(TRACK, F.concat("_n", F.lit(":b")).alias("seq"), F.col("end").alias("t")))
    snapped = snap_to_silence(ends, silences, snap_s, bucket_s).withColumn("_n", F.split("seq", ":")[0].cast("int"))
    side = lambda s: F.max(F.when(F.col("seq").endswith(s), F.col("snapped")))
    moved = snapped.groupBy(TRACK, "_n").agg(side("a").alias("_a"), side("b").alias("_b"))
    cut = numbered.join(moved, [TRACK, "_n"])
    keep = F.col("_b") > F.col("_a")
    cut = cut.select(TRACK, F.when(keep, F.col("_a")).otherwise(F.col("start")).alias("start"), F.when(keep, F.col("_b")).otherwise(F.col("end")).alias("end"))
    alone = spans.select(TRACK, "start", "end").join(segments.select(TRACK).distinct(), TRACK, "left_anti")
    merged = coalesce_spans(cut.join(segments.select(TRACK).distinct(), TRACK, "left_semi"))
    kept = subtract_spans(segments, merged, bucket_s).join(spans.select(TRACK).distinct().withColumn("_cut", F.lit(True)), TRACK, "left")
    kept = kept.where(F.col("_cut").isNull() | (F.col("end") - F.col("start") >= min_keep_s)).drop("_cut")
    return kept, merged.unionByName(alone)


def voiced_blocks(segments: DataFrame, gap: float = 3.0) -> DataFrame:
    """Adds ``block``: segments chained while the next starts at most ``gap`` after the previous end."""
    w = Window.partitionBy(TRACK).orderBy("start", "end", "seq")
    new = F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    return segments.withColumn("_new", new).withColumn("block", F.sum("_new").over(_upto("start", "end", "seq"))).drop("_new")


def song_cores(spans: DataFrame, expandable: DataFrame, gap: float = 15.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """Spans (with seq) of the clusters, at most ``gap`` apart, in which a span overlaps an expandable one."""
    reach = F.max("end").over(_before("start", "end"))
    clustered = spans.withColumn("_reach", reach).withColumn("_c", F.sum(F.when(F.col("start") - F.col("_reach") <= gap, 0).otherwise(1)).over(_upto("start", "end")))
    live = overlapping(clustered, expandable, bucket_s=bucket_s).select(TRACK, "_c").distinct()
    return clustered.join(live, [TRACK, "_c"], "left_semi").select(*spans.columns)


def expand_to_voiced_blocks(
    segments: DataFrame, spans: DataFrame, expandable: DataFrame, protect: DataFrame, block_gap: float = 3.0, core_gap: float = 15.0, bucket_s: float = BUCKET_S
) -> DataFrame:
    """Song spans grown over the voiced blocks that an expandable span touches.

    Clean speech (segments overlapping ``protect`` but no song core) is trimmed from both
    edges of a block first; a block of nothing else is left out.
    """
    cores = song_cores(spans, expandable, core_gap, bucket_s)
    blocks = voiced_blocks(segments, block_gap)
    marks = lambda other, name: overlapping(segments.select(TRACK, "seq", "start", "end"), other, bucket_s=bucket_s).select(TRACK, "seq").withColumn(name, F.lit(True))
    blocks = blocks.join(marks(protect, "_p"), [TRACK, "seq"], "left").join(marks(cores, "_core"), [TRACK, "seq"], "left")
    clean = F.coalesce("_p", F.lit(False)) & ~F.coalesce("_core", F.lit(False))
    hull = blocks.groupBy(TRACK, "block").agg(
        F.min(F.struct("start", "end")).getField("start").alias("start"),
        F.max(F.struct("start", "end")).getField("end").alias("end"),
        F.min(F.when(~clean, F.col("start"))).alias("_from"),
        F.max(F.when(~clean, F.struct("start", "end"))).getField("end").alias("_to"),
    )
    hull = hull.withColumn("seq", F.col("block"))
    live = overlapping(hull, expandable, bucket_s=bucket_s).where("_from is not null")
    grown = live.select(TRACK, F.col("_from").alias("start"), F.col("_to").alias("end"))
    return coalesce_spans(spans.select(TRACK, "start", "end").unionByName(grown))


def group_by_spans(segments: DataFrame, spans: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``grp``: a new group begins where a span lies between a segment and the one before."""
    w = Window.partitionBy(TRACK).orderBy("start", "end", "seq")
    gaps = segments.select(TRACK, "seq", F.lag("end").over(w).alias("_s"), F.col("start").alias("_e"))
    gaps = gaps.where("_s < _e").select(TRACK, "seq", F.col("_s").alias("start"), F.col("_e").alias("end"))
    cut = overlapping(gaps, spans, bucket_s=bucket_s).select(TRACK, "seq").withColumn("_new", F.lit(1))
    marked = segments.join(cut, [TRACK, "seq"], "left")
    return marked.withColumn("grp", F.sum(F.coalesce("_new", F.lit(0))).over(_upto("start", "end", "seq"))).drop("_new")


def rescue_speech(speech: DataFrame, segments: DataFrame, min_s: float = 3.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """Stretches of speech spans (with seq) that no segment covers and that last ``min_s`` at least."""
    return subtract_spans(speech.select(TRACK, "seq", "start", "end"), segments, bucket_s).where(F.col("end") - F.col("start") >= min_s)


def dominant_label(spans: DataFrame, turns: DataFrame, floor_s: float = 0.05, label: str = "speaker", bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds to each span (with seq) the label of the turns (with seq) that overlap it longest in sum.

    Null below ``floor_s``; of equal sums the label whose turn comes first wins. A span that
    touches two buckets at most stays one row: it meets the list of the turns in reach of
    its first bucket, and no pairs are made or brought back. Longer spans are joined pair by pair.
    """
    number = lambda c: F.floor(F.col(c) / bucket_s)
    buckets = F.explode(F.sequence(number("start") - 1, number("end")))
    listed = turns.where("start <= end").select(TRACK, buckets.alias("_b"), F.struct("start", "end", "seq", F.col(label).alias("label")).alias("_x"))
    listed = listed.groupBy(TRACK, "_b").agg(F.array_sort(F.collect_list("_x")).alias("_near"))
    length = lambda x: overlap(F.col("start"), F.col("end"), x["start"], x["end"])
    wide = F.coalesce(number("end") - number("start") > 1, F.lit(False))
    rows = spans.where(~wide).withColumn("_b", number("start")).join(listed, [TRACK, "_b"], "left")
    rows = rows.withColumn("_hits", F.when(F.col("end") > F.col("start"), F.filter("_near", lambda x: length(x) > 0)))
    one = F.col("_hits")[0]
    total = lambda of: F.round(F.aggregate(F.filter("_hits", lambda x: x["label"].eqNullSafe(of)), F.lit(0.0), lambda acc, x: acc + length(x)), 6)
    # hits are in the order of their turns, so that labels are in the order of their first ones
    named = F.transform(F.array_distinct(F.transform("_hits", lambda x: x["label"])), lambda of, k: F.struct((-total(of)).alias("ov"), k.alias("k"), of.alias("label")))
    single = F.when(F.round(length(one), 6) >= floor_s, one["label"])
    rows = rows.withColumn("_best", F.when(F.size("_hits") > 1, F.array_min(named)))
    several = F.when(-F.col("_best")["ov"] >= floor_s, F.col("_best")["label"])
    near = rows.select(*spans.columns, F.when(F.size("_hits") == 1, single).when(F.size("_hits") > 1, several).alias(label))
    long = spans.where(wide)
    pairs = interval_join(long.where("end > start").select(TRACK, "seq", "start", "end"), turns.select(TRACK, "seq", "start", "end", label), bucket_s=bucket_s)
    shared = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    sums = pairs.groupBy(TRACK, "seq", F.col(f"r_{label}").alias(label)).agg(F.round(F.sum(shared), 6).alias("_ov"), F.min(F.struct("r_start", "r_end", "r_seq")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(TRACK, "seq").orderBy(F.desc("_ov"), "_first"))
    best = sums.withColumn("_r", rank).where("_r = 1").where(F.col("_ov") >= floor_s)
    return near.unionByName(long.join(best.select(TRACK, "seq", label), [TRACK, "seq"], "left").select(near.columns))


def covered_share(spans: DataFrame, cover: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``share``: summed overlap with ``cover`` divided by the span's length; null for empty spans."""
    pairs = interval_join(spans.select(TRACK, "seq", "start", "end"), cover.select(TRACK, "start", "end"), bucket_s=bucket_s)
    sums = pairs.groupBy(TRACK, "seq").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("_ov"))
    out = spans.join(sums, [TRACK, "seq"], "left")
    length = F.col("end") - F.col("start")
    return out.withColumn("share", F.when(length > 0, F.coalesce("_ov", F.lit(0.0)) / length)).drop("_ov")


def nearest_point(points: DataFrame, marks: DataFrame, reach_s: float) -> DataFrame:
    """Adds ``nearest`` to points (track_id, seq, t): the closest mark (track_id, t) within reach, the earlier of two.

    That is the last mark before a point or the first behind it: both sides are sorted together, no pairs are made.
    """
    other = marks.where("t is not null").select(TRACK, F.col("t").cast("double").alias("_mark")).where(F.col(TRACK).isNotNull())
    rows = points.withColumn("_mark", F.lit(None).cast("double")).withColumn("_at", F.col("t").cast("double")).unionByName(other.withColumn("_at", F.col("_mark")), allowMissingColumns=True)
    here = F.col("_mark").isNull()
    side = lambda by: F.last("_mark", ignorenulls=True).over(Window.partitionBy(TRACK).orderBy(by, here).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_before", side(F.asc("_at"))).withColumn("_behind", side(F.desc("_at"))).where(here)
    apart = lambda c: F.abs(F.col(c) - F.col("t"))
    near = lambda c: F.when((apart(c) <= reach_s) & (F.col(c) >= F.col("t") - reach_s) & (F.col(c) <= F.col("t") + reach_s), F.struct(apart(c).alias("d"), F.col(c).alias("at")))
    return rows.withColumn("nearest", F.least(near("_before"), near("_behind"))["at"]).select(*points.columns, "nearest")


def smooth_turns(turns: DataFrame, drop_s: float = 0.2, gap_s: float = 0.35, bucket_s: float = BUCKET_S) -> DataFrame:
    """Turns (track_id, seq, start, end, speaker) without contained fragments, same-speaker neighbours merged."""
    inside = (F.col("r_speaker") != F.col("speaker")) & (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    short = turns.where(F.col("end") - F.col("start") < drop_s)
    gone = interval_join(short, turns, inside, "closed", bucket_s).select(TRACK, "seq").distinct()
    kept = turns.join(gone, [TRACK, "seq"], "left_anti")
    order = ("start", "end", "seq")
    w = Window.partitionBy(TRACK).orderBy(*order)
    kept = kept.withColumn("_run", F.sum(F.when(F.col("speaker") == F.lag("speaker").over(w), 0).otherwise(1)).over(_upto(*order)))
    reach = F.max("end").over(_before(*order, keys=(TRACK, "_run")))
    kept = kept.withColumn("_reach", reach)
    isle = F.sum(F.when(F.col("start") - F.col("_reach") < gap_s, 0).otherwise(1)).over(_upto(*order))
    merged = kept.withColumn("_isle", isle).groupBy(TRACK, "_isle", "speaker").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(TRACK, "start", "end", "speaker")


def sound_events(windows: DataFrame, tags: DataFrame, width: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """Tagged events from windows (track_id, t, probs) and classes (idx, tag): best class, runs of one tag merged."""
    # the class table is a fixed list of a few dozen tags; a longer one is joined as Spark sees fit
    tags = F.broadcast(tags) if tags.count() <= MOST_TAGS else tags
    scored = windows.select(TRACK, "t", F.posexplode("probs").alias("idx", "p")).join(tags, "idx").where(F.col("p") >= threshold)
    best = scored.groupBy(TRACK, "t").agg(F.min(F.struct((-F.col("p")).alias("p"), "idx", "tag"))["tag"].alias("tag"))
    w = Window.partitionBy(TRACK).orderBy("t")
    goes_on = (F.lag("tag").over(w) == F.col("tag")) & (F.col("t") <= F.lag(F.col("t") + width).over(w) + F.lit(1e-6))
    runs = best.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(_upto("t")))
    return runs.groupBy(TRACK, "_run", "tag").agg(F.min("t").alias("start"), (F.max("t") + width).alias("end")).select(TRACK, "start", "end", "tag")


def fit_events_to_gaps(events: DataFrame, cues: DataFrame, min_s: float = 5.0 / 6.0, max_s: float = 7.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """The longest cue-free piece of each event (with seq), the first of equals; short ones go, long ones are capped."""
    free = subtract_spans(events, cues.where("start is not null and end is not null"), bucket_s)
    rank = F.row_number().over(Window.partitionBy(TRACK, "seq").orderBy(F.desc(F.col("end") - F.col("start")), "start"))
    best = free.withColumn("_r", rank).where("_r = 1").drop("_r").where(F.col("end") - F.col("start") >= min_s)
    return best.withColumn("end", F.least("end", F.col("start") + max_s))


def fade_gain(samples: DataFrame, mute: DataFrame, fade_s: float = 0.05, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``gain`` to samples (track_id, t): 0 inside mute spans, a linear ramp over ``fade_s`` on both sides, else 1."""
    wide = mute.select(TRACK, (F.col("start") - fade_s).alias("start"), (F.col("end") + fade_s).alias("end"), F.col("start").alias("a"), F.col("end").alias("b"))
    at = samples.select(TRACK, "t", F.col("t").alias("start"), F.col("t").alias("end")).distinct()
    near = interval_join(at, wide, how="closed", bucket_s=bucket_s)
    away = F.greatest(F.col("r_a") - F.col("t"), F.col("t") - F.col("r_b"), F.lit(0.0)) / fade_s
    return samples.join(near.groupBy(TRACK, "t").agg(F.min(away).alias("gain")), [TRACK, "t"], "left").withColumn("gain", F.coalesce("gain", F.lit(1.0)))


def mask_outside_speech(frames: DataFrame, speech: DataFrame, dilate_s: float = 0.12, penalty: float = -4.0, bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``bias`` to frames (track_id, t, blank): ``penalty`` on non-blank frames outside dilated speech.

    A track without speech spans is left alone.
    """
    wide = speech.select(TRACK, (F.col("start") - dilate_s).alias("start"), (F.col("end") + dilate_s).alias("end"))
    inside = within_spans(frames.select(TRACK, "t").distinct(), wide, bucket_s).withColumn("_in", F.lit(True))
    known = speech.select(TRACK).distinct().withColumn("_known", F.lit(True))
    out = frames.join(inside, [TRACK, "t"], "left").join(known, TRACK, "left")
    outside = F.col("_known").isNotNull() & F.col("_in").isNull() & ~F.col("blank")
    return out.withColumn("bias", F.when(outside, penalty).otherwise(0.0)).drop("_in", "_known")
