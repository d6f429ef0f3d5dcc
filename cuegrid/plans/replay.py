"""From words to polished cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import UNSPACED_LAYOUT, max_line_length, max_lines, thresholds
from ..functions.layout import wrapped
from ..functions.text import merge_stutters, reading_chars, strip_punctuation, visual_width
from ..operators import folds, packing, particles
from ..operators.atoms import split_oversized
from ..operators.intervals import BUCKET_S, TRACK, nearest_point
from ..operators.stretches import by_keys, changes, numbering, spelled
from ..operators.timing import break_flags, cue_numbers, ordered, polish_timing


def cues_from_words(words: DataFrame, speech: DataFrame | None = None, clause_ms: int | None = None, skip_ms: int | None = None, offline_ms: int | None = None, bucket_s: float = BUCKET_S) -> DataFrame:
    """Cues (track_id, seq, lang, text, start, end, word_data, lyric): words between qualifying pauses."""
    th = thresholds(F.col("lang"))
    limit = lambda name, given: F.lit(given) if given is not None else th[name]
    flagged = cue_numbers(break_flags(words, limit("clause_ms", clause_ms), limit("skip_ms", skip_ms), limit("offline_ms", offline_ms), speech, bucket_s))
    return cues_of(flagged)


def segmented(words: DataFrame, speech: DataFrame | None = None, bucket_s: float = BUCKET_S) -> DataFrame:
    """Cues as ``cues_from_words``, moreover within the width and duration of their language, cut where least is left hanging.

    Words too wide for a line are cut first, so that every cue fits.
    """
    th = thresholds(F.col("lang"))
    words = split_oversized(words.select(TRACK, "seq", "lang", "text", "start", "end"))
    flagged = break_flags(words, th["clause_ms"], th["skip_ms"], th["offline_ms"], speech, bucket_s)
    return cues_of(packing.pack_cues(packing.unstick(flagged, F.col("lang"), th["clause_ms"], th["skip_ms"]), by_track=True), in_order=True)


def pieces_of_tracks(units: DataFrame, most_s: float = 3600.0, pause_s: float = 2.0) -> DataFrame:
    """Adds ``piece`` to units (track_id, seq, start, end): long tracks cut at pauses of ``pause_s`` at least.

    A piece goes up to the last such pause within ``most_s`` of its start, or to the first
    one if there is none in reach. Steps that never look across such a pause may take
    (track_id, piece) for the track.
    """
    track = Window.partitionBy(TRACK).orderBy("seq")
    upto = track.rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("_open", F.coalesce(F.col("start") - F.max("end").over(track.rowsBetween(Window.unboundedPreceding, -1)) >= pause_s, F.lit(False)))
    rows = rows.withColumn("_part", F.count_if("_open").over(upto).cast("int"))
    parts = rows.groupBy(TRACK, F.col("_part").alias("k")).agg(F.min("start").alias("_s"), F.max("end").alias("_e")).withColumn("_us", F.round(F.col("_s") * 1e6).cast("long"))
    reach = Window.partitionBy(TRACK).orderBy("_us").rangeBetween(0, round(most_s * 1e6))
    whole = Window.partitionBy(TRACK)
    parts = parts.withColumn("_to", F.greatest(F.max("k").over(reach), F.col("k") + 1)).withColumn("_rest", F.max("_e").over(whole) - F.col("_s")).withColumn("_end", F.max("k").over(whole))
    hops = parts.select(TRACK, "k", F.when((F.col("_rest") > most_s) & (F.col("k") < F.col("_end")), F.col("_to")).cast("int").alias("to"))
    heads = folds.followed(hops).select(TRACK, F.col("k").alias("_part"), F.lit(True).alias("_head"))
    rows = rows.join(heads, [TRACK, "_part"], "left").withColumn("_new", F.coalesce("_head", F.lit(False)) & (F.col("_open") | (F.row_number().over(track) == 1)))
    return rows.withColumn("piece", (F.count_if("_new").over(upto) - 1).cast("int")).drop("_open", "_part", "_head", "_new")


def cues_of(flagged: DataFrame, in_order: bool = False) -> DataFrame:
    """Cues of words that know their cue; numbers of cues ascend with seq. ``in_order``: the words lie in the order of the track already.

    The words of a track pass in order, whole Arrow batches at a time; a task holds a batch
    and the words of the cue that is not complete yet.
    """
    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema}
    schema = f"{TRACK} {kinds[TRACK]}, seq int, lang {kinds['lang']}, text string, start {kinds['start']}, end {kinds['end']}, word_data array<struct<start:{kinds['start']},end:{kinds['end']}>>, lyric boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            starts = changes(held.column(TRACK), held.column("cue"))
            if len(starts) > 1:
                yield _cues(held.slice(0, int(starts[-1])), starts[:-1])
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield _cues(held, np.zeros(1, np.int64))

    # the number is kept so that the order of its window is
    number = [] if in_order else [F.row_number().over(ordered()).alias("_k")]
    rows = flagged.select(TRACK, F.col("cue").cast("int").alias("cue"), "lang", "text", "start", "end", *number)
    return rows.mapInArrow(run, schema)


def _cues(words: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """One row for the words from each start to the next, or for each of their languages."""
    langs = changes(words.column("lang"))
    if len(np.setdiff1d(langs, starts)):
        cue = np.repeat(np.arange(len(starts)), np.diff([*starts, words.num_rows]))
        lang = words.column("lang").dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((lang, cue))
        words, cue, lang = words.take(pa.array(order)), cue[order], lang[order]
        starts = changes(pa.array(cue), pa.array(lang))
    ends = np.append(starts, words.num_rows)
    heads = words.take(pa.array(starts))
    said = words.column("text")
    at = np.append(0, np.cumsum(said.is_valid().to_numpy(zero_copy_only=False)))[ends]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), said.drop_null())
    loose = pc.is_in(heads.column("lang"), pa.array(UNSPACED_LAYOUT))
    text = pc.if_else(loose, pc.binary_join(lists, ""), pc.binary_join(lists, " "))
    times = []
    for side, least, none in (("start", np.fmin, np.inf), ("end", np.maximum, -np.inf)):
        column = words.column(side)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        value = least.reduceat(np.where(known, column.to_numpy(zero_copy_only=False), none), starts)
        times.append(pa.array(value, column.type, mask=~np.logical_or.reduceat(known, starts)))
    spans = pa.StructArray.from_arrays([words.column("start"), words.column("end")], ["start", "end"])
    data = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
    columns = [heads.column(TRACK), heads.column("cue"), heads.column("lang"), text, *times, data, pa.array(np.zeros(len(starts), bool))]
    return pa.RecordBatch.from_arrays(columns, [TRACK, "seq", "lang", "text", "start", "end", "word_data", "lyric"])


def pack_words(words: DataFrame, offline_ms: int = 700) -> DataFrame:
    """Adds ``brk`` and ``cue``: cuts at long pauses, and where the width or duration of a cue would be exceeded.

    The spaced, penalty-free form of packing: a fold over a track's words, which pass in
    order, once; a task holds a batch and the width and start of the open cue.
    """
    lang = F.col("lang")
    rows = break_flags(words, F.lit(400), F.lit(1000), F.lit(offline_ms)).withColumns({"_w": visual_width(F.col("text")), "_room": max_line_length(lang) * max_lines(lang)})
    given = [c for c in rows.columns if c not in ("brk", "_w", "_room")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracks, number = by_keys(TRACK), numbering(TRACK)
        held: dict = {}  # between two pauses, for each language: number of the open cue, its width and start
        before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first, brk = tracks(batch), batch.column("brk").to_numpy(zero_copy_only=False)
            new = brk.copy()
            columns = [batch.column(c).to_pylist() for c in ("lang", "_w", "_room", "start", "end")]
            for i, (opens, g, w, room, start, end) in enumerate(zip((first | brk).tolist(), *columns, strict=True)):
                if opens:
                    held = {}
                part, cells, since = held.get(g, (0, -1, None))
                late = end is not None and since is not None and end - since > 7.0
                if cells == -1 or (cells is not None and (late or (w is not None and cells + 1 + w > room))):
                    part += cells != -1
                    cells, since = w, start
                elif cells is not None:
                    cells = None if w is None else cells + 1 + w
                held[g] = part, cells, since
                if not opens and part != before:
                    new[i] = True
                before = part
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], pa.array(new), pa.array(number(batch, new) + 1)], [*given, "brk", "cue"])

    return rows.mapInArrow(run, spelled(rows.select(*given), "brk boolean", "cue bigint"))


def polish(cues: DataFrame) -> DataFrame:
    """Timing polish with each language's thresholds."""
    th = thresholds(F.col("lang"))
    return polish_timing(cues, th["min_cue_s"], th["max_cue_s"], th["cps"], th["lag_out_s"], reading_chars(F.col("text")))


def finish_text(cues: DataFrame) -> DataFrame:
    """Punctuation dropped, stutters joined, lines wrapped."""
    plain = merge_stutters(strip_punctuation(F.col("text")))
    # the plain text is worked out once, not wherever the wrap names it
    rows = cues.select("*", F.inline(F.array(F.struct(plain.alias("_plain")))))
    return rows.withColumn("text", wrapped(F.col("_plain"), F.col("lang"), max_lines(F.col("lang")))).select(cues.columns)


def full_polish(cues: DataFrame, shots: DataFrame | None = None, line: int = 42, lines: int = 2, max_s: float = 7.0, in_order: bool = False) -> DataFrame:
    """Stranded particles mended, micro cues merged, fragments glued, timing polished, edges moved to shot changes, text finished.

    ``in_order``: the cues lie in the order of the track already, as ``cues_of`` leaves them.
    """
    mended = particles.mend_particles(cues, line, lines, max_s, in_order=in_order)
    out = polish(folds.merge_and_glue(mended, 0.3, line, lines, max_s, 0.5, in_order=True))
    if shots is not None:
        for side in ("start", "end"):
            near = nearest_point(out.select(TRACK, "seq", F.col(side).alias("t")), shots, 0.458)
            out = out.join(near.select(TRACK, "seq", F.col("nearest").alias(f"{side}_cut")), [TRACK, "seq"], "left")
        out = folds.snap_to_shots(out, max_s).drop("start_cut", "end_cut")
    return finish_text(out)
