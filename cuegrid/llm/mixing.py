"""Mixing sources to target weights by capped water-filling.

Every source may be used at most ``max_epochs`` times. Targets start proportional to the
weights; sources whose target exceeds their cap are clamped there and the excess is shared
among the rest by weight, until no target is above its cap. A document of a source with
target / size = whole + fraction is taken ``whole`` times, and a seeded sample of the
source's documents is taken once more so that their words make up the fraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, code_point_rank

#: Documents of a source are dealt by hash into buckets of about so many; each bucket
#: takes its own fraction exactly, so a hot source never meets in one task.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def seeded(seed: int, *parts: Column) -> Column:
    """60 seeded bits as a long, the same on every engine that has md5; nulls are the text ``~``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cycle_weights(rank: Column, weights: tuple[float, ...] = (5, 2, 1)) -> Column:
    """Weights by rank, repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)


def water_fill(ws: Workspace, sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``_target`` to rows of (_size, _w); one row per source.

    The total to share is the sum of all sizes. Each round is one aggregate over the
    sources and returns two numbers; a source once clamped stays so, hence the rounds
    end after at most as many as there are sources, in practice a handful.
    """
    cap = F.col("_size") * F.lit(float(max_epochs))
    total, weight = sources.agg(F.sum("_size"), F.sum("_w")).first()
    level = float(total) / weight if total and weight else 0.0
    clamped = -1
    while True:
        over = cap <= F.col("_w") * F.lit(level)
        held, free, n = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))), F.count_if(over)
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (float(total) - held) / free
    return sources.withColumn("_target", F.when(over, cap).otherwise(F.col("_w") * F.lit(level)))


def mix_sources(
    docs: DataFrame,
    max_epochs: float = 3.0,
    weight: Callable[[Column], Column] = cycle_weights,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """The mix: ``keep`` columns of every document plus _size, _source_size, _target, _taken.

    Sources rank by code point, null last, and ``weight`` maps the rank to a weight. Size is
    the number of words. ``_taken`` counts the words that the mix takes of the row, repeats
    included, never above ``max_epochs`` times its size; ``_whole`` and ``_extra`` split it
    into whole repetitions and the words of a last one.

    Null or empty text: size 0, nothing taken. Null source: a source of its own. Null or
    shared doc_id: rows are told apart by their text. Repeated rows: each counts and is
    sampled by itself. Empty table: no rows. Extra columns are ignored unless in ``keep``.
    """
    keep = ["doc_id"] if keep is None else keep
    ws = Workspace(docs.sparkSession, "mix")
    named = [F.col(c).alias(f"_k_{c}") for c in keep]
    rows = ws.save(docs.select(*named, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), seeded(seed, F.col("doc_id"), F.md5("text")).alias("_u")), "sizes")
    sums = rows.groupBy("_source").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_n"))
    sources = ws.save(code_point_rank(sums, "_source", "_rank").withColumn("_w", weight(F.col("_rank"))), "sources")
    targets = water_fill(ws, sources, max_epochs)
    rate = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    targets = targets.select(
        F.col("_source").alias("_s"),
        F.col("_size").alias("_source_size"),
        "_target",
        F.floor(rate).alias("_whole"),
        (rate - F.floor(rate)).alias("_fraction"),
        F.ceil(F.col("_n") / BUCKET_ROWS).alias("_buckets"),
    )
    # a dimension of sources: Spark broadcasts it below its size threshold, else splits skewed keys
    joined = rows.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    joined = joined.withColumn("_bucket", F.col("_u") % F.col("_buckets"))
    whole = Window.partitionBy("_source", "_bucket")
    before = whole.orderBy("_u", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    dither = seeded(seed + 1, F.col("_source"), F.col("_bucket")) / F.lit(float(1 << 60))
    quota = F.floor(F.col("_fraction") * F.sum("_size").over(whole) + dither)
    left = quota - F.coalesce(F.sum("_size").over(before), F.lit(0))
    out = joined.withColumn("_extra", F.greatest(F.lit(0), F.least(left, F.col("_size"))).cast("long"))
    return out.select(
        *[F.col(f"_k_{c}").alias(c) for c in keep],
        "_size",
        "_source_size",
        "_target",
        "_whole",
        "_extra",
        (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long").alias("_taken"),
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a mix stands for: a row per repetition, the last one cut to its words.

    A cut repetition holds its first ``_extra`` words joined by one space.
    """
    n = F.col("_whole") + F.when(F.col("_extra") > 0, 1).otherwise(0)
    rows = mixed.where(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    cut = (F.col("_copy") > F.col("_whole")) & (F.col("_extra") < F.col("_size"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_extra").cast("int")), " ")
    rows = rows.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)
