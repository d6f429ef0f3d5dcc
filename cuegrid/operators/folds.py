"""Steps that depend on their own earlier results within a track.

Where the state is some numbers, a track's rows stream past it in order, so neither an array
nor a group holds a track. Passes that rewrite neighbouring cues run on the stretches
between pauses that they never look across.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import fits, is_fragment, joined, wrap
from ..plans.durable import settled
from .intervals import BUCKET_S, TRACK, interval_join
from .stretches import AHEAD, BACK, Step, by_keys, carried, in_stretches, reduced, spelled
from .timing import TWO_FRAMES, earlier, ordered, so_far

FRAME = 1.0 / 24.0
LANDING = 12 * FRAME
TINY = 1e-9


def pack_segments(segments: DataFrame, max_s: float, group: str | None = None) -> DataFrame:
    """Chunks (track_id, chunk_no, start, end) of consecutive segments no longer than ``max_s``; longer segments are cut hard.

    The start of the open chunk is carried from segment to segment; a chunk is then the
    rows that share its number.
    """
    keys = [TRACK, group] if group else [TRACK]
    limit = float(max_s)

    def opening() -> Callable[..., tuple]:
        since, chunk = None, -1

        def step(start: float, end: float) -> tuple:
            nonlocal since, chunk
            if since is not None and end - since <= limit:
                return (chunk,)
            chunk += 1
            since = None if end - start > limit else start
            return (chunk,)

        return step

    placed = carried(segments.select(*keys, "start", "end"), keys, ["start", "end"], ["start", "end"], {"_chunk": "int"}, opening)
    whole = placed.groupBy(*keys, "_chunk").agg(F.min(F.struct("start", "end"))["start"].alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"))
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / limit), F.lit(1))
    pieces = whole.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    out = pieces.select(*keys, "_chunk", "_k", (F.col("start") + F.col("_k") * limit).alias("start"), F.least(F.col("start") + (F.col("_k") + 1) * limit, F.col("end")).alias("end"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk", "_k")) - 1
    return out.select(*keys, number.alias("chunk_no"), "start", "end")


def enforce_min_duration(cues: DataFrame, min_s: float) -> DataFrame:
    """Cues last ``min_s`` where the next cue leaves room or can start later; overlaps end.

    Where the cue before has pushed a start, the new start is carried to the next row.
    """
    want = float(min_s)

    def lasting() -> Callable[..., tuple]:
        pushed = None

        def step(start: float, end: float, next_start: float | None, next_end: float | None) -> tuple:
            nonlocal pushed
            begin, pushed = start if pushed is None else pushed, None
            wish = begin + want
            if next_start is None:
                done = max(end, wish)
            elif wish <= next_start:
                done = min(max(end, wish), next_start)
            elif wish < next_end - want / 2:
                done = pushed = wish
            else:
                done = next_start
            return begin, max(done, begin + 0.001)

        return step

    track = Window.partitionBy(TRACK).orderBy("seq")
    rows = cues.withColumn("_ns", F.lead("start").over(track)).withColumn("_ne", F.lead("end").over(track))
    return carried(rows, [TRACK], ["seq"], ["start", "end", "_ns", "_ne"], {"start": "double", "end": "double"}, lasting).select(cues.columns)


def followed(hops: DataFrame) -> DataFrame:
    """(track_id, k): the places that hops (track_id, k, to) lead to from place 0, as far as they go; hops lead ahead.

    One number is carried from row to row.
    """

    def walk() -> Callable[..., tuple]:
        want = 0

        def step(k: int, to: int | None) -> tuple:
            nonlocal want
            met = k == want
            if met:
                want = -1 if to is None else to
            return (met,)

        return step

    return carried(hops.select(TRACK, "k", "to"), [TRACK], ["k"], ["k", "to"], {"met": "boolean"}, walk).where("met").select(TRACK, "k")


def plan_windows(items: DataFrame, size: str, most_items: int, most_size: int) -> DataFrame:
    """Adds ``window``: consecutive items (seq) up to a count and a summed size; an oversize item is alone.

    Where a window that begins at an item ends depends on the next ``most_items`` sizes
    alone; only the hops from window to window are followed in order.
    """
    track = Window.partitionBy(TRACK).orderBy("seq")
    rows = items.withColumn("_k", F.row_number().over(track) - 1).withColumn("_ahead", F.collect_list(F.col(size).cast("long")).over(track.rowsBetween(0, most_items - 1)))
    within = F.aggregate("_ahead", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("goes")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["goes"] & (acc["sum"] + x <= most_size), 1).otherwise(0)).alias("n"), (acc["goes"] & (acc["sum"] + x <= most_size)).alias("goes")))
    hops = rows.select(TRACK, F.col("_k").alias("k"), (F.col("_k") + F.greatest(F.lit(1), within["n"])).alias("to"))
    heads = followed(hops).select(TRACK, F.col("k").alias("_k"), F.lit(1).alias("_head"))
    placed = rows.drop("_ahead").join(heads, [TRACK, "_k"], "left")
    upto = track.rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("window", (F.sum(F.coalesce("_head", F.lit(0))).over(upto) - 1).cast("int")).drop("_k", "_head")


def plan_alignment_chunks(cues: DataFrame, max_s: float, min_gap_s: float = 1.5, pad_s: float = 0.5, bucket_s: float = BUCKET_S) -> DataFrame:
    """Runs of cues within ``max_s``, cut after the last pause of ``min_gap_s`` in reach, else after the last cue in reach.

    Rows (track_id, lo, hi, start, end): cue positions [lo, hi) and the stretch of sound to
    cut out, meeting in the middle of pauses. Cues without times ride along; a cue counts as
    ending no earlier than those before it.

    Where a run that begins at a cue would end depends on that cue alone, so the end is
    found for every cue by an interval join; only the hops from the first run to the next
    are followed in order.
    """
    track = Window.partitionBy(TRACK).orderBy("seq")
    ahead, behind = track.rowsBetween(0, Window.unboundedFollowing), track.rowsBetween(Window.unboundedPreceding, 0)
    rows = cues.select(TRACK, "seq", "start", F.when(F.col("start").isNotNull(), F.col("end")).alias("end"))
    rows = rows.withColumn("k", F.row_number().over(track) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(TRACK)))
    rows = rows.withColumn("after", F.lead("start").over(track)).withColumn("first", F.first("start", ignorenulls=True).over(ahead)).withColumn("closes", F.first("end", ignorenulls=True).over(ahead))
    rows = rows.withColumn("last", F.last("end", ignorenulls=True).over(track.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("upto", F.max("end").over(behind))
    rows = settled(rows)
    # a run goes on if the cues left do not fit
    opens = rows.where(F.col("last") - F.col("first") > max_s).where(F.col("last").isNotNull())
    reach = opens.select(TRACK, F.col("k").alias("seq"), F.col("first").alias("start"), (F.col("first") + max_s).alias("end"))
    ends = rows.where("end is not null and k < n - 1").select(TRACK, "k", F.col("upto").alias("start"), F.col("upto").alias("end"), F.coalesce(F.col("after") - F.col("end") >= min_gap_s, F.lit(False)).alias("quiet"))
    near = interval_join(reach, ends, F.col("r_k") >= F.col("seq"), "closed", bucket_s)
    best = near.groupBy(TRACK, "seq").agg(F.max(F.when(F.col("r_quiet"), F.col("r_k"))).alias("_quiet"), F.max("r_k").alias("_any"))
    cut = opens.select(TRACK, F.col("k").alias("seq"), "n").join(best, [TRACK, "seq"], "left").withColumn("cut", F.coalesce("_quiet", "_any", "seq"))
    hop = cut.where("cut < n - 1").select(TRACK, F.col("seq").alias("k"), (F.col("cut") + 1).alias("to"))
    runs = followed(rows.select(TRACK, "k").join(hop, [TRACK, "k"], "left")).withColumnRenamed("k", "lo")
    runs = runs.withColumn("hi", F.lead("lo").over(Window.partitionBy(TRACK).orderBy("lo")))
    # where the sound is cut after a cue: in the middle of the pause, or a little after it
    between = F.when(F.col("closes").isNull(), F.coalesce("last", F.lit(0.0))).when(F.col("after").isNull(), F.col("closes") + pad_s).otherwise((F.col("closes") + F.col("after")) / 2)
    edges = rows.select(TRACK, (F.col("k") + 1).alias("_at"), between.alias("_cut"))
    head = rows.where("k = 0").select(TRACK, "n", F.greatest(F.lit(0.0), F.coalesce("first", F.lit(0.0)) - pad_s).alias("_from"))
    tail = F.max(F.struct("k", "end")).alias("_tail")
    out = runs.join(head, TRACK).join(edges.select(TRACK, F.col("_at").alias("lo"), F.col("_cut").alias("_a")), [TRACK, "lo"], "left").join(edges.select(TRACK, F.col("_at").alias("hi"), F.col("_cut").alias("_b")), [TRACK, "hi"], "left")
    lasts = rows.where("end is not null").groupBy(TRACK).agg(tail)
    out = out.join(lasts, TRACK, "left")
    final = F.when(F.col("_tail")["k"] >= F.col("lo"), F.col("_tail")["end"]).otherwise(0.0) + pad_s
    return out.select(
        TRACK, "lo", F.coalesce("hi", "n").cast("int").alias("hi"), F.when(F.col("lo") == 0, F.col("_from")).otherwise(F.col("_a")).alias("start"), F.when(F.col("hi").isNull(), F.coalesce(final, F.lit(pad_s))).otherwise(F.col("_b")).alias("end")
    )


def _per_track(cues: DataFrame, change: Callable[[list[dict]], list[dict]], gap_s: float | None = None, alone_stays: bool = True, in_order: bool = False, deal: bool = False) -> DataFrame:
    """Applies a pass to each track's cues in order; seq is given anew.

    With ``gap_s`` the pass never looks across a pause of that length, counted from the
    latest end so far, and each stretch between such pauses is passed by itself. ``deal``:
    the stretches are dealt out, so that a long track is many tasks'.
    """

    def opening() -> Callable[[pa.RecordBatch], np.ndarray]:
        tracks, latest = by_keys(TRACK), -np.inf

        def opens(batch: pa.RecordBatch) -> np.ndarray:
            nonlocal latest
            new = tracks(batch)
            start = pc.fill_null(batch.column("start"), np.nan).to_numpy()
            end = pc.fill_null(batch.column("end"), -np.inf).to_numpy()
            paused = np.zeros(len(new), bool)
            if gap_s is not None:
                firsts = np.flatnonzero(new).tolist()
                for lo, hi in zip([0, *firsts], [*firsts, len(new)], strict=True):
                    if hi > lo:
                        so_far = np.maximum.accumulate(np.append(-np.inf if new[lo] else latest, end[lo:hi]))
                        latest = float(so_far[-1])
                        paused[lo:hi] = (start[lo:hi] - so_far[:-1] >= gap_s) & (so_far[:-1] > -np.inf)
            return new | paused

        return opens

    # a cue between two such pauses has nothing to be joined with
    if deal and gap_s is not None:
        paused = F.coalesce(F.col("start") - F.max("end").over(earlier()) >= gap_s, F.lit(False))
        rows = cues.withColumn("_paused", paused).withColumn("_block", F.count_if("_paused").over(so_far())).drop("_paused")
        rows = rows.repartition(TRACK, "_block").sortWithinPartitions(TRACK, "_block", "seq")
        done = in_stretches(rows, TRACK, lambda: by_keys(TRACK, "_block"), lambda _, __, size: (size > 1) | (not alone_stays), change, spelled(rows))
        place = F.row_number().over(Window.partitionBy(TRACK).orderBy("_block", "seq")) - 1
        return done.withColumn("seq", place.cast(cues.schema["seq"].dataType)).select(cues.columns)
    rows = cues if in_order else cues.withColumn("_k", F.row_number().over(ordered()))  # kept so that the order of its window is
    return in_stretches(rows, TRACK, opening, lambda _, __, size: (size > 1) | (not alone_stays), change, spelled(rows)).select(cues.columns)


def _one(host: dict, a: dict, b: dict, lang: str, start: float, end: float) -> dict:
    """Two neighbours as one cue, with the other fields of ``host``."""
    return host | {"text": joined(a["text"], b["text"], lang), "start": start, "end": end, "word_data": a["word_data"] + b["word_data"]}


def _chains(gap_s: float, line: int, max_s: float, min_s: float, floor_s: float) -> Step:
    """The rule of ``merge_micro``: a cue goes into its successor if both make a line, or are too short to be read apart."""

    def step(_: dict | None, a: dict, b: dict | None) -> tuple[str, dict] | None:
        if b is None or b["start"] - a["end"] >= gap_s:
            return None
        both = _one(a, a, b, b["lang"], a["start"], max(a["end"], b["end"]))
        whole = b["end"] - a["start"]
        legal = whole <= max_s and fits(both["text"], line, 1, b["lang"])
        flicker = whole < min_s or all(c["end"] - c["start"] < floor_s for c in (a, b))
        if not (legal or flicker):
            return None
        return AHEAD, both | {"_rewrap": a.get("_rewrap", False) or not legal}

    return step


def _glues(gap_s: float, line: int, lines: int, max_s: float) -> Step:
    """The rule of ``glue_fragments``: a fragment goes to the side with the shorter pause."""

    def pause(a: dict | None, b: dict | None, lang: str) -> float:
        if a is None or b is None or b["end"] - a["start"] > max_s or not fits(joined(a["text"], b["text"], lang), line, lines, lang):
            return gap_s
        return b["start"] - a["end"]

    def step(below: dict | None, a: dict, b: dict | None) -> tuple[str, dict] | None:
        if not is_fragment(a["text"], a["lang"]):
            return None
        behind, ahead = pause(below, a, a["lang"]), pause(a, b, a["lang"])
        if min(behind, ahead) >= gap_s:
            return None
        if behind <= ahead:
            return BACK, _one(below, below, a, a["lang"], below["start"], max(below["end"], a["end"]))
        return AHEAD, _one(b, a, b, a["lang"], min(a["start"], b["start"]), b["end"])

    return step


def _micro(rows: list[dict], gap_s: float, line: int, max_s: float, min_s: float, lines: int, floor_s: float) -> list[dict]:
    out = reduced(rows, _chains(gap_s, line, max_s, min_s, floor_s))
    return [c | {"text": wrap(c["text"], c["lang"], lines)} if c.pop("_rewrap", False) else c for c in out]


def _glued(rows: list[dict], gap_s: float, line: int, lines: int, max_s: float) -> list[dict]:
    return reduced(rows, _glues(gap_s, line, lines, max_s))


def merge_micro(cues: DataFrame, gap_s: float, line: int, max_s: float, min_s: float = 0.0, lines: int = 1, floor_s: float = 0.08, in_order: bool = False) -> DataFrame:
    """Cues less than ``gap_s`` apart become one if that fits a line and ``max_s``.

    Cues that collapsed to almost nothing, or that together stay below ``min_s``, are
    folded whatever their length, and wrapped anew. ``in_order``: the cues lie in the order of the track already.
    """
    return cues if gap_s <= 0 else _per_track(cues, lambda rows: _micro(rows, gap_s, line, max_s, min_s, lines, floor_s), gap_s, in_order=in_order)


def glue_fragments(cues: DataFrame, gap_s: float, line: int, lines: int, max_s: float) -> DataFrame:
    """A lone short word joins the neighbour that is nearer, the previous one of two, within budget and cap."""
    return cues if gap_s <= 0 else _per_track(cues, lambda rows: _glued(rows, gap_s, line, lines, max_s), gap_s)


def merge_and_glue(cues: DataFrame, gap_s: float, line: int, lines: int, max_s: float, min_s: float, floor_s: float = 0.08, in_order: bool = False) -> DataFrame:
    """``merge_micro`` and then ``glue_fragments`` in one visit to each track. ``in_order``: the cues lie in the order of the track already."""
    return cues if gap_s <= 0 else _per_track(cues, lambda rows: _glued(_micro(rows, gap_s, line, max_s, min_s, lines, floor_s), gap_s, line, lines, max_s), gap_s, in_order=in_order, deal=not in_order)


def _moved_start(start: float, cut: float) -> float:
    d = start - cut
    if d < 0:
        return cut if d >= -7 * FRAME - TINY else cut - LANDING
    return cut if d <= 9 * FRAME + TINY else cut + LANDING


def snap_to_shots(cues: DataFrame, max_s: float) -> DataFrame:
    """Cue edges near shot changes move by the zones of the 24-frame rules.

    Cues carry start_cut and end_cut, the nearest cut of each edge within reach (see
    ``intervals.nearest_point``). Speech is never cut and the cue before never overlapped;
    its new end is carried along. seq is given anew.
    """

    def snapping() -> Callable[..., tuple]:
        behind = None

        def step(start: float, end: float, start_cut: float | None, end_cut: float | None, spoken: float, after: float | None) -> tuple:
            nonlocal behind
            floor = float("-inf") if behind is None else behind + TWO_FRAMES
            if start_cut is not None and abs(start_cut - start) > TINY:
                new = max(_moved_start(start, start_cut), floor)
                if new < end - TWO_FRAMES and new - start <= LANDING:
                    start = new
            if end_cut is not None:
                end = _moved_end(start, end, end_cut, spoken, float("inf") if after is None else after, max_s)
            behind = end
            return start, end

        return step

    track = Window.partitionBy(TRACK).orderBy("seq")
    known = F.array_max(F.transform("word_data", lambda w: w["end"]))
    rows = cues.withColumn("_spoken", F.coalesce(known, "end")).withColumn("_after", F.lead("start").over(track)).withColumn("_place", F.row_number().over(track) - 1)
    done = carried(rows, [TRACK], ["_place"], ["start", "end", "start_cut", "end_cut", "_spoken", "_after"], {"start": "double", "end": "double"}, snapping)
    return done.withColumn("seq", F.col("_place").cast(cues.schema["seq"].dataType)).select(cues.columns)


def _moved_end(start: float, end: float, cut: float, spoken: float, after: float, max_s: float) -> float:
    """Onto the frames before the cut, or to a landing behind it, where speech and the next cue allow."""
    near = end - cut <= 5 * FRAME + TINY
    free = lambda t: t <= after - TWO_FRAMES and t - start <= max_s
    before, behind = cut - TWO_FRAMES, cut + LANDING
    aim = before if near else behind
    if free(aim) if aim > end + TINY else (aim < end - TINY and aim >= spoken and aim > start):
        return aim
    return behind if near and end > cut and behind > end and free(behind) else end
