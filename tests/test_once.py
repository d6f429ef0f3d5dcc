"""Expressions are worked out once for a row, however long the row is."""

import random
import time

from pyspark.sql import functions as F

from cuegrid.functions import text as tx
from cuegrid.operators import align, atoms, clauses, metrics, review
from cuegrid.plans import replay


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_found_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 0, "é-𝒜3b", 0.0, 0.8), (1, 1, "...", 1.0, 1.5), (1, 2, "x", 3.0, 2.0), (2, 0, None, 0.0, 1.0)], "track_id int, seq int, text string, start double, end double")
    letters = align.explode_characters(rows)
    got = [tuple(r) for r in letters.orderBy("track_id", "seq", "k").collect()]
    assert got == [(1, 0, 0, "é", 0.0, 0.2), (1, 0, 1, "𝒜", 0.2, 0.4), (1, 0, 2, "3", 0.4, 0.6000000000000001), (1, 0, 3, "b", 0.6000000000000001, 0.8), (1, 2, 0, "x", 3.0, 3.0)]
    assert "lambdafunction" not in plan(letters)


def test_a_break_in_a_long_cue(spark):
    rows = spark.createDataFrame([("the cat " * 15000, "en"), ("(the) of, THE. cat", "en"), ("the of", "en"), ("", "en"), ("a b c d", None)], "text string, lang string")
    words = tx.spaced_tokens(F.col("text"))
    began = time.time()
    got = [r[0] for r in rows.select(tx.legal_break(words, F.col("lang"), F.floor(F.size(words) / 2).cast("int"))).collect()]
    assert got == [15000, 1, 1, 1, 2] and time.time() - began < 20


def test_a_vote_counts_each_script_once(spark):
    rows = spark.createDataFrame([(1, 0, "English", "plain words in here"), (2, 0, "ja, en", "これは日本語です"), (3, 0, "de", "...")], "track_id int, seq int, detected string, text string")
    voted = metrics.vote_language(rows)
    assert sorted(map(tuple, voted.collect())) == [(1, "en"), (2, "ja"), (3, "english")]
    assert 0 < plan(voted).count("regexp_extract_all(") <= 6


def test_a_translation_is_cleaned_once(spark):
    cues = spark.createDataFrame([(1, 0, "-a\n-b", False), (1, 1, "x “y”", True), (1, 2, "one two", False), (1, 3, None, False)], "track_id int, seq int, text string, lyric boolean")
    answers = spark.createDataFrame([(1, 2, " eins, “zwei” " + "und " * 20), (1, 3, "vier.")], "track_id int, i int, t string")
    out = review.translated_cues(cues, answers, "de")
    got = [r["text"] for r in out.orderBy("seq").collect()]
    assert got[:2] == ["-a\n-b", "♪ x y ♪"] and got[2].replace("\n", " ") == "eins zwei " + " ".join(["und"] * 20) and got[2].count("\n") >= 1 and got[3] == "vier"
    # the whole text once, and the two halves of a cue of two speakers
    assert plan(out).count("translate(") <= 3


def joins(rows):
    return rows._jdf.queryExecution().sparkPlan().toString().count("Join")


def test_wide_words_are_cut_without_losing_order(spark):
    rows = [(1, k, "en", "x" * 100 if k % 3 == 0 else "ok", None if k == 6 else float(k), k + 0.5) for k in range(9)] + [(2, 0, None, None, 0.0, 1.0), (2, 1, "ja", "語" * 30, 1.0, 2.0)]
    words = spark.createDataFrame(rows, "track_id int, seq int, lang string, text string, start double, end double")
    out = atoms.split_oversized(words)
    assert "Eval" not in out._jdf.queryExecution().sparkPlan().toString()  # short words do not pass a function
    got = [tuple(r) for r in out.orderBy("track_id", "seq").collect()]
    want = []
    for t, _, lang, text, s, e in rows:
        parts = [text[a:b] for a, b in ((0, 25), (25, 50), (50, 75), (75, 100))] if text and text[0] == "x" else ["語" * 15] * 2 if text and text[0] == "語" else [text]
        step = max(0.0, e - s) / len(parts) if s is not None else 0.0
        for k, p in enumerate(parts):
            a, b = (None, None) if s is None else (s + k * step, s + (k + 1) * step)
            want.append((t, lang, p, a if k else s, e if k == len(parts) - 1 else b))
    assert [(t, g, p, a, b) for t, _, g, p, a, b in got] == want
    assert [r[1] for r in got] == [*range(18), *range(3)]


def test_phrases_and_clauses_meet_words_without_joins(spark):
    words = spark.createDataFrame([(t, k, f"w{k}", float(k), k + 0.5) for t in (1, 2) for k in range(7)] + [(None, 0, "w0", 0.0, 1.0)], "track_id int, seq int, text string, start double, end double")
    phrases = spark.createDataFrame([(1, 0, "w0 w1"), (1, 1, "w2w3 w4"), (1, 2, "w5w"), (1, 3, "6"), (2, 0, "w"), (2, 1, "0"), (None, 0, "w0")], "track_id int, seq int, text string")
    marked = atoms.phrase_starts(words, phrases)
    assert [r["phrase"] for r in marked.orderBy("track_id", "seq").collect()] == [False] + [True, False, True, False, False, True, False] + [True, False, False, False, False, False, False]
    blocks = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 3), (1, 3, 9), (1, 4, 1), (2, 0, 0), (2, 1, 4), (3, 0, 1), (None, 0, 1)], "track_id int, seq int, n int")
    timed = clauses.with_times(blocks, words)
    got = {(r["track_id"], r["seq"]): (r["start"], r["end"]) for r in timed.collect()}
    none = (None, None)
    assert got == {(1, 0): (0.0, 1.5), (1, 1): none, (1, 2): (2.0, 4.5), (1, 3): (5.0, 6.5), (1, 4): none, (2, 0): none, (2, 1): (0.0, 3.5), (3, 0): none, (None, 0): none}
    assert joins(marked) == joins(timed) == 0


def test_words_are_packed_in_order(spark):
    r = random.Random(5)
    rows = []
    for t in range(3):
        at = 0.0
        for k in range(4000 if t == 0 else 60):
            at += r.choice([0.05, 0.05, 0.05, 0.9]) if t else 0.01
            rows.append((t, k, "en", "x" * r.randint(1, 12), at, at + 0.2))
            at += 0.2
    rows += [(9, 0, "en", None, 0.0, 1.0), (9, 1, "en", "a", None, None), (9, 2, "en", "b", 9.0, 9.5)]
    packed = replay.pack_words(spark.createDataFrame(rows, "track_id int, seq int, lang string, text string, start double, end double"))
    assert joins(packed) == 0
    got = {(x["track_id"], x["seq"]): x["cue"] for x in packed.collect()}
    track, cue, width, since, last = None, 0, 0, 0.0, 0.0
    for t, k, _, text, s, e in rows[:-3]:
        if t != track:
            track, cue, width, since = t, 0, len(text), s
        elif (s - last) * 1000 >= 700 or width + 1 + len(text) > 84 or e - since > 7:
            cue, width, since = cue + 1, len(text), s
        else:
            width += 1 + len(text)
        last = e
        assert got[t, k] == cue
    assert [got[9, k] for k in range(3)] == [0, 0, 0]
