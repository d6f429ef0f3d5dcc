"""Clauses and model seams."""

import uuid

from pyspark.sql import functions as F

from cuegrid.operators import clauses, seams


def test_comma_clauses(spark):
    rows = [
        ("en", "Well, I think so, but 10,000 people came, and then they left."),
        ("en", "No, no, no, no."),
        ("zh", "你好，世界，今天的天气真好，我们走吧"),
        ("en", "no commas here"),
    ]
    frame = spark.createDataFrame(rows, "lang string, s string")
    got = [r[0] for r in frame.select(clauses.comma_clauses(F.col("s"), F.col("lang"))).collect()]
    assert ["".join(g) for g in got] == [s for _, s in rows]
    assert got[0] == ["Well, I think so,", " but 10,000 people came,", " and then they left."] or len(got[0]) >= 2
    assert got[1] == ["No, no,", " no, no."] and got[3] == ["no commas here"]
    assert all(len(x.rstrip("，")) >= 2 for x in got[2])


def test_clause_cues_and_segments(spark):
    texts = spark.createDataFrame([(1, "en", "Hello there. How are you? Fine"), (2, "zh", "你好。走吧")], "track_id int, lang string, text string")
    words = [(1, k, "en", w, float(k), k + 0.5) for k, w in enumerate("Hello there. How are you?".split())]
    words += [(2, k, "zh", w, float(k), k + 0.5) for k, w in enumerate("你好。走吧")]
    units = spark.createDataFrame(words, "track_id int, seq int, lang string, text string, start double, end double")
    got = [tuple(r) for r in clauses.clause_cues(texts, units).orderBy("track_id", "seq").collect()]
    assert got == [(1, 0, "en", "Hello there.", 0.0, 1.5), (1, 1, "en", "How are you?", 2.0, 4.5), (1, 2, "en", "Fine", None, None), (2, 0, "zh", "你好。", 0.0, 2.5), (2, 1, "zh", "走吧", 3.0, 4.5)]
    assert {r["track_id"]: r["text"] for r in clauses.one_segment(units).collect()} == {1: "Hello there. How are you?", 2: "你好。走吧"}


def test_untimed_cue_shares_time(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    cue = spark.createDataFrame([(1, 0, "en", text, 0.0, 10.0)], "track_id int, seq int, lang string, text string, start double, end double")
    got = clauses.split_untimed(cue, F.lit(2)).orderBy("part").collect()
    assert len(got) == 2 and got[0]["start"] == 0.0 and got[1]["end"] == 10.0 and got[0]["end"] == got[1]["start"]
    assert " ".join(r["text"] for r in got) == text


def test_anchor(spark):
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate("a b c d b".split())], "track_id int, seq int, text string")
    want = spark.createDataFrame([(1, 0, 3, "b"), (1, 1, 2, "c"), (1, 2, 0, "x")], "track_id int, seq int, at int, text string")
    assert [(r["found"], r["ok"]) for r in clauses.anchored_words(want, words).orderBy("seq").collect()] == [(4, True), (2, True), (0, False)]


def test_chunks_fail_alone(spark):
    def call(chunk):
        if chunk["chunk_no"] == 1 or chunk["track_id"] == 2:
            raise ValueError("no sound")
        return [{"text": f"t{chunk['chunk_no']}", "start": 0.0}]

    chunks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "track_id int, chunk_no int")
    got = seams.per_chunk(chunks, call, "text string, start double").orderBy("track_id", "chunk_no")
    assert [(r["text"], r["error"]) for r in got.collect()] == [("t0", None), (None, "ValueError: no sound"), ("t2", None), (None, "ValueError: no sound")]
    assert [r["track_id"] for r in seams.all_failed(got).collect()] == [2]


def test_windows_carry_context_and_resume(spark):
    def ask(items, before):
        if items[0]["t"] == "bad":
            raise RuntimeError("busy")
        return {r["i"]: f"{r['t']}|{len(before)}" for r in items} | {99: "stray"}

    items = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 2, "bad"), (1, 2, 3, "c")], "track_id int, window int, i int, t string")
    got = seams.answer_windows(items, ask, rounds=1).orderBy("window", "i").collect()
    assert [(r["i"], r["t"], r["error"]) for r in got] == [(0, "a|0", None), (1, "b|0", None), (None, None, "RuntimeError: busy"), (3, "c|2", None)]
    done = seams.pending(items, spark.createDataFrame([], "track_id int, signature string, i int")).where("i < 2")
    assert {r["i"] for r in seams.pending(items, done).collect()} == {2, 3}
    assert seams.pending(items.withColumn("t", F.upper("t")), done).count() == 4


def test_a_run_that_stopped_is_taken_up_where_it_was(spark, tmp_path):
    """Calls are written down by the workers, so that a text asked for twice would show."""
    log = tmp_path / "calls"
    log.mkdir()

    def ask(items, before):
        name = f"{items[0]['t']}-{len(before)}"
        with open(log / f"{name}-{uuid.uuid4().hex}", "w") as f:
            f.write("|".join(x["t"] for x in items))
        if items[0]["t"].startswith("fails") and not (tmp_path / "well").exists():
            raise ValueError("no")
        return {x["i"]: x["t"].upper() for x in items if x["t"] != "skipped"}

    rows = [(t, w, 2 * w + k, f"{t}{w}{k}") for t in ("a", "b") for w in range(4) for k in range(2)]
    rows[2] = ("a", 1, 2, "fails")
    rows[-1] = ("b", 3, 7, "skipped")
    items = spark.createDataFrame(rows, "track_id string, window int, i int, t string")
    state = str(tmp_path / "state")
    calls = lambda: [f.read_text() for f in log.iterdir()]
    first = seams.answer_windows(items, ask, state, rounds=1, most_waves=2)
    assert first.where("error is null").count() == 6 and first.where("error is not null").count() == 1 and len(calls()) == 4
    whole = seams.answer_windows(items, ask, state, rounds=1)
    assert {(x["track_id"], x["i"]) for x in whole.where("error is null").collect()} == {(t, i) for t, _, i, x in rows if x not in ("fails", "skipped", "a11")}
    assert whole.where("error is not null").count() == 1
    asked = [x for c in calls() for x in c.split("|")]
    assert {x for x in asked if asked.count(x) > 1} == {"fails", "a11"}  # the failed window alone is asked for again
    (tmp_path / "well").touch()
    changed = items.withColumn("t", F.when(F.col("i") == 0, F.concat("t", F.lit("new"))).otherwise(F.col("t")))
    last = {(x["track_id"], x["i"]): x["t"] for x in seams.answer_windows(changed, ask, state, rounds=1).collect()}
    assert last[("a", 0)] == "A00NEW" and last[("a", 2)] == "FAILS" and last[("b", 1)] == "B01" and ("b", 7) not in last
    # the tail before the failed window holds answers from before it, at most three
    assert any(f.name.startswith("fails-2") for f in log.iterdir())
    assert seams.answer_windows(items.where("false"), ask).count() == 0
