"""Whole results where a rule of thumb had held back, and steps that were too slow for long tables."""

import random

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuegrid import queries
from cuegrid.operators import align, packing, particles, speakers, stored
from cuegrid.operators.stretches import Units
from cuegrid.plans import replay, streams


def against_sql(spark, name, folder, texts):
    """Rows of a query over made documents, and those of its SQL."""
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = db.execute(queries.ORACLES[name])
    order = [d[0] for d in found.description]
    return sorted(map(tuple, got.select(order).collect())), sorted(found.fetchall())


def test_texts_of_few_letters_are_repaired_as_their_sql_says(spark, tmp_path):
    texts = [x for n in (1, 2, 3, 4, 5) for x in 3 * ["oh what"[:n] if n < 3 else "so it was"[: n + 1]]]
    got, want = against_sql(spark, "q14_repaired_language", tmp_path, texts)
    assert got == want


def test_a_given_language_holds_for_its_tracks_alone(spark):
    units = spark.createDataFrame([(1, 0, "en", "了中", 0.0, 0.2, "zh"), (2, 0, "en", "了中", 0.0, 0.2, None)], "track_id int, seq int, lang string, text string, start double, end double, given string")
    got = sorted(tuple(r)[:4] for r in stored.repair_language(units, units["given"]).collect())
    assert got == [(1, 0, "zh", "了"), (1, 1, "zh", "中"), (2, 0, "en", "了中")]


def test_cues_are_taken_apart_by_ranges_and_costs_are_asked_only_where_both_sides_fit(monkeypatch):
    text = "のをにへしでとがまよりたなは" * 4
    units = Units.of([{"start": 0.2 * k, "end": 0.2 * k + 0.2} for k in range(len(text))])
    cues, at = [], 0
    while at < len(text):
        n = 4 + at % 5
        own, units = units.parted(min(n, len(units)))
        cues.append({"lang": "ja", "text": text[at : at + n], "start": own.first_start(), "end": own.last_end(), "word_data": own})
        at += n
    asked = []
    recut = particles._Edge.recut
    monkeypatch.setattr(particles._Edge, "recut", lambda self, at: asked.append(at) or recut(self, at))
    out = particles.zipped(cues, 9, 1, 7.0, 0.3)
    assert "".join(c["text"] for c in out) == text
    assert [len(c["word_data"]) for c in out] == [len(c["text"]) for c in out]
    assert all(c["word_data"].start is units.start for c in out) and len(asked) <= len(cues)


def test_letters_are_not_dealt_out_again(spark):
    plan = align.explode_characters(streams.word_stream(spark.createDataFrame([(1, "en", "so it was.")], "doc_id long, lang string, text string")))
    numbered = plan.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("seq", "k")))
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_words_are_packed_with_widths_looked_up(monkeypatch):
    """A word's width is measured once however often its cue is cut, and a wrap is tried word by word."""
    words = [{"text": f"word{k % 7},", "start": 0.4 * k, "end": 0.4 * k + 0.3, "brk": k % 90 == 89} for k in range(400)]
    measured = []
    monkeypatch.setattr(packing, "width", lambda s: measured.append(s) or len(s))
    monkeypatch.setattr(packing, "fits", lambda *_: 1 / 0)
    sizes = packing.cue_sizes(words, "en", 7.0)
    assert sum(sizes) == 400 and len(measured) == 400
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    assert {89, 179, 269, 359} <= set(ends)
    assert all(words[b - 1]["end"] - words[b - n]["start"] <= 7.0 for b, n in zip(ends, sizes, strict=True))


def test_texts_are_finished_once_and_stutters_sought_once(spark):
    cues = spark.createDataFrame([(1, 0, "en", "I I I, think so so.", 0.0, 1.0), (1, 1, "en", None, 1.0, 2.0), (1, 2, "en", "a word " * 20, 2.0, 3.0)], "track_id int, seq int, lang string, text string, start double, end double")
    out = replay.finish_text(cues)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and len([x for x in plan.splitlines() if "(?i)" in x]) == 1
    texts = [r["text"] for r in out.orderBy("seq").collect()]
    assert texts[:2] == ["I-I-I think so-so", None] and texts[2].replace("\n", " ") == " ".join(["a word"] * 20)


def test_runs_are_absorbed_as_by_the_column_form(spark):
    r = random.Random(8)
    rows = [[(r.choice("AB" if k % 2 else "ABC"), r.choice([0.05, 0.1, 0.11, 0.15, 0.19, 0.3, 0.6])) for _ in range(r.randrange(1, 14))] for k in range(400)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, words array<struct<speaker:string,length:double>>")
    want = {x["k"]: x["s"] for x in frame.select("k", speakers.absorb_tiny_runs(F.col("words")).alias("s")).collect()}
    assert [speakers.absorbed(x) for x in rows] == [want[k] for k in range(400)]


def test_only_words_of_cues_with_several_speakers_are_listed(spark):
    cues = spark.createDataFrame([(1, k, float(4 * k), 4.0 * k + 4, "a b c d", "en", False) for k in range(3)], "track_id int, seq int, start double, end double, text string, lang string, lyric boolean")
    words = spark.createDataFrame([(1, k // 4, k % 4, "abcd"[k % 4], float(k), k + 0.9) for k in range(12)], "track_id int, cue int, k int, text string, start double, end double")
    turns = spark.createDataFrame([(1, 0, 0.0, 6.0, "A"), (1, 1, 6.0, 12.0, "B")], "track_id int, seq int, start double, end double, speaker string")
    out = speakers.format_speakers(cues, words, turns)
    assert "(_runs#" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["text"] for r in out.orderBy("seq").collect()] == ["a b c d", "-a b\n-c d", "a b c d"]


def test_track_documents_are_read_once(spark, tmp_path):
    got, want = against_sql(spark, "s8_track_documents", tmp_path, ["so it was, in the end.", "yes", "one two. three"])
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[5] for r in got] == [r[5] for r in want]
    plan = queries.QUERIES["s8_track_documents"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("Relation [") == 3
