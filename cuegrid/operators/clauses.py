"""Sentences and clauses of a track's text, and the words that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import WIDE, spaced
from ..functions.layout import wrapped
from ..functions.text import PAUSE_COMMAS, join_tokens, once, reading_chars, sentences, tokens, visual_length
from .intervals import TRACK
from .timing import ordered, so_far

#: Least visible length of a clause before a cut at a comma: in wide scripts, and in others.
MIN_WIDE, MIN_OTHER = 6, 18


def comma_pieces(s: Column, unspaced: Column) -> Column:
    """A sentence cut after each pause comma; not inside numbers, and in spaced languages only before a blank."""
    marks = f"[,{PAUSE_COMMAS}]"
    tight = F.split(s, rf"(?<={marks})(?!(?<=[0-9]{marks})[0-9])(?=.)")
    return F.when(unspaced, tight).otherwise(F.split(s, r"(?U)(?<=,)(?=\s)"))


def comma_clauses(s: Column, lang: Column) -> Column:
    """Comma pieces gathered until a clause is long enough, never with more than one inner comma."""
    unspaced = ~spaced(lang)
    least = F.when(lang.isin(*WIDE), MIN_WIDE).otherwise(MIN_OTHER)
    marks = F.when(unspaced, f"[,{PAUSE_COMMAS}]").otherwise(",")

    def load(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), F.concat(marks, F.lit("+$")), F.lit(""))
        return F.regexp_count(bare, marks)

    def step(acc: Column, piece: Column) -> Column:
        def cut(over: Column) -> Column:
            done = F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
            now = F.when(over, piece).otherwise(F.concat(acc["open"], piece))
            return once(F.struct(done.alias("done"), now.alias("now"), (visual_length(now, ~unspaced) >= least).alias("full")), kept)

        return once((acc["open"] != "") & (load(F.concat(acc["open"], piece)) > 1), cut)

    def kept(x: Column) -> Column:
        done = F.when(x["full"], F.concat(x["done"], F.array(x["now"]))).otherwise(x["done"])
        return F.struct(done.alias("done"), F.when(x["full"], "").otherwise(x["now"]).alias("open"))

    def finish(acc: Column) -> Column:
        done, rest = acc["done"], acc["open"]
        last = F.element_at(F.concat(F.array(F.lit("")), done), -1)
        joins = (F.size(done) > 0) & (visual_length(rest, ~unspaced) < least) & (load(F.concat(last, rest)) <= 1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, rest)))
        return F.when(rest == "", done).when(joins, grown).otherwise(F.concat(done, F.array(rest)))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(comma_pieces(s, unspaced), start, step, finish)


def clause_table(texts: DataFrame, at_commas: bool = True) -> DataFrame:
    """(track_id, seq, lang, text, n): the clauses of each text (track_id, lang, text) and their number of units.

    Units are words, in unspaced languages characters.
    """
    parts = sentences(F.col("text"))
    if at_commas:
        parts = F.flatten(F.transform(parts, lambda x: comma_clauses(x, F.col("lang"))))
    rows = texts.select(TRACK, "lang", F.posexplode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).alias("seq", "text"))
    n = F.when(spaced(F.col("lang")), F.size(tokens(F.col("text"), F.lit(True)))).otherwise(reading_chars(F.col("text")))
    return rows.withColumn("n", n)


def clause_cues(texts: DataFrame, units: DataFrame, at_commas: bool = True) -> DataFrame:
    """Clauses with the times of the units (track_id, seq, start, end) they take in order.

    A clause beyond the units has no times.
    """
    return with_times(clause_table(texts, at_commas), units).select(TRACK, "seq", "lang", "text", "start", "end")


def with_times(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Adds start of the first and end of the last of the units (track_id, seq, start, end) that blocks (track_id, seq, n) take in order, n each.

    Nothing is joined: heads of blocks, units and ends of blocks pass in the order of the track.
    """
    kind, some = F.col("_kind"), (F.col("n") > 0) & F.col(TRACK).isNotNull()
    placed = blocks.withColumn("_hi", F.sum("n").over(so_far())).withColumn("_lo", F.col("_hi") - F.col("n"))
    heads = placed.where(some).select(TRACK, F.col("_lo").alias("_at"), F.lit(0).alias("_kind"))
    numbered = units.select(TRACK, (F.row_number().over(ordered()) - 1).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    tails = placed.select(*blocks.columns, "_lo", (F.col("_hi") - 1).alias("_at"), F.lit(2).alias("_kind"))
    rows = tails.unionByName(numbered, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy(TRACK).orderBy("_at", "_kind")
    last = lambda x: F.last(x, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_next", F.lead(F.when(kind == 1, F.col("_start"))).over(order))
    rows = rows.withColumn("_head", last(F.when(kind == 0, F.struct("_next")))).withColumn("_unit", last(F.when(kind == 1, F.struct("_at", "_end"))))
    ended = F.when(some & (F.col("_unit")["_at"] >= F.col("_lo")), F.col("_unit")["_end"])
    return rows.where(kind == 2).select(*blocks.columns, F.when(some, F.col("_head")["_next"]).alias("start"), ended.alias("end"))


def one_segment(units: DataFrame) -> DataFrame:
    """A track's units (track_id, seq, lang, text, start, end) as one segment."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    rows = units.groupBy(TRACK, "lang").agg(F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("_p"))
    return rows.select(TRACK, "lang", "start", "end", join_tokens(F.transform("_p", lambda x: x["text"]), spaced(F.col("lang"))).alias("text"))


def split_untimed(cues: DataFrame, lines: Column) -> DataFrame:
    """Cues (track_id, seq, lang, text, start, end) without word times, cut into display lines that share the time by their characters."""
    parts = F.split(wrapped(F.col("text"), F.col("lang"), lines), "\n")
    rows = cues.select(TRACK, "seq", "lang", "start", "end", F.posexplode(parts).alias("part", "text")).withColumn("_n", F.greatest(reading_chars(F.col("text")), F.lit(1)))
    cue = Window.partitionBy(TRACK, "seq")
    upto = F.sum("_n").over(cue.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / F.col("_all")
    rows = rows.withColumn("_all", F.sum("_n").over(cue)).withColumn("_upto", upto)
    return rows.select(TRACK, "seq", "part", "lang", "text", share(F.col("_upto") - F.col("_n")).alias("start"), share(F.col("_upto")).alias("end"))


def anchored_words(clauses: DataFrame, words: DataFrame, reach: int = 8) -> DataFrame:
    """Where each clause's first word lies: its expected place, or the nearest equal word within ``reach``, the later of two.

    Clauses have (track_id, seq, at, text), ``at`` being the expected position and text the
    first word; words (track_id, seq, text). Adds ``found`` and ``ok``.
    """
    near = clauses.withColumn("_k", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    hit = near.join(words.select(TRACK, F.col("seq").alias("_k"), F.col("text").alias("_w")), [TRACK, "_k"]).where(F.trim("_w") == F.trim("text"))
    best = hit.groupBy(TRACK, "seq").agg(F.min(F.struct(F.abs(F.col("_k") - F.col("at")).alias("d"), (-F.col("_k")).alias("neg")))["neg"].alias("_neg"))
    out = clauses.join(best, [TRACK, "seq"], "left")
    return out.withColumn("ok", F.col("_neg").isNotNull()).withColumn("found", F.coalesce(-F.col("_neg"), F.col("at"))).drop("_neg")
