"""Long runs of one kind that could exhaust a recursive matcher or a fold."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import language, text
from cuegrid.operators import atoms, folds, semantic

N = 20_000
FORMS = {
    "latin words": "word " * N,
    "hyphens": "-".join(["word"] * N),
    "dots": "a.b-c_" * N,
    "percents": "50 % " * N,
    "unit signs": "%" * N,
    "blanks": " " * N,
    "digits": "7 " * N,
    "han": "字" * N,
    "mixed": "字word " * N,
    "apostrophes": "a'b’c-" * N,
}


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame([(k, v) for k, v in FORMS.items()], "name string, text string")


def plain_units(s):
    """The rule one character at a time."""
    out, i = [], 0
    ascii_ = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
    while i < len(s):
        if s[i].isspace():
            i += 1
        elif s[i] in ascii_:
            j = end = i
            while j < len(s) and (s[j] in ascii_ or s[j].isspace()):
                end = j + 1 if s[j] in ascii_ else end
                j += 1
            out.append(s[i:end])
            i = end
        elif s[i] in text.UNIT_SIGNS and out and out[-1][-1] in "0123456789":
            out[-1] += s[i]
            i += 1
        else:
            out.append(s[i])
            i += 1
    return out


def test_unspaced_tokens_of_long_runs(hostile):
    got = {r["name"]: list(r["t"]) for r in hostile.select("name", text.unspaced_tokens(F.col("text")).alias("t")).collect()}
    assert got == {k: plain_units(v) for k, v in FORMS.items()}


def test_unspaced_tokens_of_random_texts(spark):
    r = random.Random(6)
    rows = [("".join(r.choices(["5", "a", " ", "%", "℃", "字", ".", "-", "\n", "　", "b7"], k=r.randrange(0, 30))),) for _ in range(500)]
    for row in spark.createDataFrame(rows, "text string").select("text", text.unspaced_tokens(F.col("text")).alias("t")).collect():
        assert list(row["t"]) == plain_units(row["text"])


def test_measures_of_long_runs(hostile):
    got = hostile.select(
        "name",
        language.dominant_script(F.col("text")).alias("script"),
        F.regexp_count("text", F.lit(language.LATIN_WORD)).alias("words"),
        text.content_mass(F.col("text")).alias("mass"),
        F.size(text.spaced_tokens(F.col("text"))).alias("tokens"),
        F.length(text.merge_stutters(F.col("text"))).alias("stutters"),
        F.size(text.sentences(F.col("text"))).alias("sentences"),
        F.length(text.strip_for_translation(F.col("text"))).alias("bare"),
        language.reconcile(F.lit("ja, en"), F.col("text")).alias("language"),
    )
    rows = {r["name"]: r for r in got.collect()}
    assert rows["hyphens"]["words"] == 1 and rows["latin words"]["words"] == N and rows["latin words"]["script"] == "latin"
    assert rows["han"]["script"] == "han" and rows["blanks"]["script"] is None and rows["latin words"]["tokens"] == N


def test_atoms_of_long_runs_in_either_writing(spark, hostile):
    rows = hostile.select(F.col("name").alias("track_id"), "text", F.explode(F.array(F.lit("ja"), F.lit("en"))).alias("lang"))
    rows = rows.select(F.concat("track_id", "lang").alias("track_id"), F.lit(0).cast("long").alias("seq"), "text", "lang", F.lit(0.0).alias("start"), F.lit(9.0).alias("end"))
    assert atoms.text_atoms(rows).count() > N


@pytest.mark.parametrize("beam", [1, 4, 64])
def test_the_fallback_survives_any_beam(spark, beam):
    """24 words, edges up to 6 long, and a fallback that costs more than all others; one fallback that is no path."""
    edges = [(t, 0, s, s + n, 50 + n, 100 if n == 1 else 1) for t in ("a", "b") for s in range(24) for n in range(1, 7) if s + n <= 24]
    edges = spark.createDataFrame(edges, "track_id string, window int, src long, dst long, quality int, host int")
    breaks = {"a": [1, 2, 3, 4, 5, 6, 12, 18], "b": [12]}
    given = spark.createDataFrame([(t, 0, b) for t, b in breaks.items()], "track_id string, window int, breaks array<long>")
    options = semantic.path_options(edges, given, 12, beam)
    rows = options.orderBy("track_id", "option").collect()
    for t in ("a", "b"):
        own = [r for r in rows if r["track_id"] == t]
        assert [r["option"] for r in own] == list(range(len(own))) and own[0]["breaks"] == breaks[t]
        assert [r["fallback"] for r in own] == [True] + [False] * (len(own) - 1)
        assert len({tuple(r["breaks"]) for r in own}) == len(own)
    a = next(r for r in rows if r["track_id"] == "a")
    assert a["host"] == 6 * 100 + 3 and a["cues"] == 9 and a["quality"] == pytest.approx((6 * 51 + 6 * 56 * 3) / 24)
    assert next(r for r in rows if r["track_id"] == "b")["quality"] is None
    replies = spark.createDataFrame([("a", 0, '{"choice": 1}'), ("b", 0, "none")], "track_id string, window int, raw string")
    chosen = {r["track_id"]: r for r in semantic.checked_choices(options, replies).collect()}
    assert set(chosen) == {"a", "b"} and chosen["b"]["breaks"] == [12] and chosen["b"]["why"] == "no object"


def test_one_track_of_many_rows_streams(spark):
    """Half a million rows without a pause: a million hops took minutes when a track was an array."""
    many = 500_000
    hops = spark.range(many).select(F.lit(1).alias("track_id"), F.col("id").cast("int").alias("k"), (F.col("id") + 1 + F.col("id") % 3).cast("int").alias("to"))
    want, at = 0, 0
    while at < many:
        want, at = want + 1, at + 1 + at % 3
    assert folds.followed(hops).count() == want
    spans = spark.range(many).select(F.lit(1).alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 0.5).alias("start"), (F.col("id") * 0.5 + 0.4).alias("end"))
    assert folds.pack_segments(spans, 12.0).count() == -(-many // 24)
    assert folds.enforce_min_duration(spans, 0.45).where("end - start > 0.4499").count() == many
    shots = spans.select("*", F.array(F.struct(F.col("start"), F.col("end"))).alias("word_data"), (F.col("start") + 0.05).alias("start_cut"), (F.col("end") + 0.02).alias("end_cut"))
    assert folds.snap_to_shots(shots, 7.0).where("start > seq * 0.5").count() > many // 2
