"""Subtitle files, track documents, edits and translations, speakers, boundaries, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import align, metrics, review, semantic, speakers
from cuegrid.sources import subtitles as sub
from cuegrid.sources import tracks
from cuegrid.streaming import spans as streaming

FILE = "track_id string, text string"
CUE = "track_id string, seq int, start double, end double, text string, lyric boolean"


def parsed(df):
    return [tuple(r)[1:] for r in df.orderBy("track_id", "seq").collect()]


def test_vtt(spark):
    text = "﻿WEBVTT\r\n\r\nNOTE x\n\n1\n00:01.000 --> 00:02.500 align:start\nSea\nmist\n\n♪ heave ho ♪\n\n♪ ♪\n\n \t\nplain"
    got = parsed(sub.parse_vtt(spark.createDataFrame([("a", text)], FILE)))
    assert got == [(0, 1.0, 2.5, "Sea\nmist", False), (1, None, None, "heave ho", True), (2, None, None, "plain", False)]


def test_ass(spark):
    head = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\nComment: 0,0:00:00.00,0:00:01.00,D,no\n"
    text = head + "Dialogue: 0,0:00:05.00,0:00:06.00,D,later, with comma\nDialogue: 0,0:00:01.00,0:00:02.00,D,{\\pos(1,2)}one\\Ntwo {\\i1\\b1}it{\\i0} {\\i1}open\nDialogue: 0,0:00:03.00,0:00:04.00,D,{\\i1}♪ shanty ♪{\\i0}\n"
    got = parsed(sub.parse_ass(spark.createDataFrame([("a", text)], FILE)))
    assert got == [(0, 1.0, 2.0, "one\ntwo <i>it</i> <i>open</i>", False), (1, 3.0, 4.0, "shanty", True), (2, 5.0, 6.0, "later, with comma", False)]


def test_files_and_order(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes("WEBVTT\n\n00:05.000 --> 00:04.000\né\n\n00:01.000 --> 00:02.000\nfirst\n".encode("utf-16"))
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n海風\n".encode("gb18030"))
    got = sub.read_cues(spark, str(tmp_path)).orderBy(F.regexp_extract("track_id", "[^/]+$", 0), "seq").collect()
    assert [(r["seq"], r["start"], r["end"], r["text"]) for r in got] == [(0, 1.0, 2.0, "first"), (1, 4.0, 5.0, "é"), (0, 1.0, 2.0, "海風")]
    (tmp_path / "c.vtt").write_text("[Script Info]\n[Events]\n")
    with pytest.raises(Exception, match="content and ending differ"):
        sub.read_cues(spark, str(tmp_path)).collect()


def test_render(spark):
    cues = spark.createDataFrame([("a", 0, 1.0, 2.5, "x\ny", False), ("a", 1, None, None, "plain", False), ("a", 2, 3.0, 4.0, "la {b} <i>c</i>", True)], CUE)
    assert sub.render_vtt(cues).first()["text"] == "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nx\ny\n\nplain\n\n00:00:03.000 --> 00:00:04.000\n♪ la {b} <i>c</i> ♪\n"
    assert sub.render_srt(cues).first()["text"] == "1\n00:00:01,000 --> 00:00:02,500\nx\ny\n\n2\n00:00:03,000 --> 00:00:04,000\n♪ la {b} <i>c</i> ♪\n"
    ass = sub.render_ass(cues).first()["text"]
    assert "Dialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,x\\Ny\n" in ass and ass.endswith(",,{\\i1}♪ la (b) {\\i1}c{\\i0} ♪{\\i0}\n")
    assert "Style: Default,Arial,72," in ass and "Style: Default,Arial,144," in sub.render_ass(cues, 2160).first()["text"]
    assert list(sub.export(cues, ["srt", "srt", "vtt"], "ass")) == ["srt", "vtt"]
    for formats, source in ((["doc"], None), (["srt"], "srt")):
        with pytest.raises(ValueError):
            sub.export(cues, formats, source)


def test_tags_media_language(spark):
    cues = spark.createDataFrame([("a", 0, 1.0, 2.0, "x", False), ("a", 1, None, None, "end", False)], CUE)
    events = spark.createDataFrame([("a", 0.5, 0.9, "oars"), ("a", 1.0, 1.5, "bell")], "track_id string, start double, end double, tag string")
    assert [r["text"] for r in sub.with_sound_tags(cues, events).orderBy("seq").collect()] == ["[oars]", "x", "[bell]", "end"]
    files = spark.createDataFrame([("d/f.mp4",), ("d/f.MKV",), ("d/g.wav",), ("d/h.txt",)], "path string")
    assert {tuple(r) for r in sub.pick_media(files).collect()} == {("d/f", "d/f.MKV"), ("d/g", "d/g.wav")}
    tag = files.select(sub.language_of_path(F.lit("x/film.en-US.vtt")), sub.language_of_path(F.lit("film.vtt"))).first()
    assert tuple(tag) == ("en", None)
    log = spark.createDataFrame([("a", "n:1 pts_time:3.5 x"), ("a", "pts_time:3.5"), ("a", "none")], "track_id string, value string")
    assert [r["t"] for r in sub.shot_times(log).collect()] == [3.5]


def test_track_documents(spark, tmp_path):
    doc = {"language": "en", "segments": [{"start": 0.0, "end": 1.0, "text": "hi", "words": [{"word": "hi", "start": 0.0, "end": 1.0}]}], "word_segments": [{"word": "hi", "start": 0.0, "end": 1.0}]}
    doc |= {"vad_speech": [[0, 1], [2], [3, 2]], "speaker_turns": [[0, 1, "A"], ["x", 1, "B"]], "shot_changes": [1.5, None, 1.5]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    read = tracks.read_tracks(spark, str(tmp_path))
    assert [(r["text"], r["lang"], len(r["word_data"])) for r in tracks.cues(read).collect()] == [("hi", "en", 1)]
    assert [(r["start"], r["end"]) for r in tracks.spans(read, "vad_speech").collect()] == [(0.0, 1.0)]
    assert [r["speaker"] for r in tracks.turns(read).collect()] == ["A"] and [r["t"] for r in tracks.shots(read).collect()] == [1.5]
    again = tracks.documents(tracks.cues(read), tracks.words(read), read.select("track_id", F.col("language").alias("lang"))).first()
    assert json.loads(again["value"])["word_segments"] == doc["word_segments"]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="not a track document"):
        tracks.read_tracks(spark, str(tmp_path)).collect()


def test_fix_gate(spark):
    cues = spark.createDataFrame([("a", 0, "a plain\nline of words"), ("a", 1, "second")], "track_id string, seq int, text string")
    rows = [(9, "x", "y"), (0, "a plain line of word", "x"), (0, "a plain line of words", "a plain  line of words"), (0, "a plain line of words", " "), (1, "second", "second " * 9), (0, "a plain line of words", "zzzz qqqq"), (0, "a plain line of words", "a plane line of words"), (0, "a plain line of words", "a plainer line of words")]
    fixes = spark.createDataFrame([("a", k, i, o, f) for k, (i, o, f) in enumerate(rows)], "track_id string, seq int, i int, orig string, fixed string")
    gated = review.gate_fixes(cues, fixes)
    assert [r["why"] for r in gated.orderBy("seq").collect()] == ["index out of range", "misquote", "no-op", "empty", "expansion", "rewrite", None, None]
    assert [r["text"] for r in review.apply_fixes(cues, gated).orderBy("seq").collect()] == ["a plainer line of words", "second"]


def test_translation(spark):
    cues = spark.createDataFrame([("a", 0, "-hello\n-you", False), ("a", 1, "song", True), ("a", 2, "plain, text", False)], "track_id string, seq int, text string, lyric boolean")
    items = review.payload(cues)
    units = review.speaker_units(items)
    assert sorted((r["i"], r["t"]) for r in units.collect()) == [(0, "hello"), (1, "song"), (2, "plain, text"), (1_000_000, "you")]
    replies = spark.createDataFrame([("a", 'Sure! {"translations": [{"i": 0, "t": "- hallo"}, {"i": "1000000", "t": "du"}, {"i": "x", "t": "?"}, {"i": 1, "t": "Lied"}]} done')], "track_id string, raw string")
    answers = review.last_answer(review.parse_translations(replies))
    whole = review.collapse_units(items, answers)
    assert {r["i"]: r["t"] for r in whole.collect()} == {0: "hallo\ndu", 1: "Lied"}
    assert [r["i"] for r in review.missing_answers(items, whole).collect()] == [2]
    assert [r["text"] for r in review.translated_cues(cues, whole, "de").orderBy("seq").collect()] == ["-hallo\n-du", "♪ Lied ♪", "plain text"]
    half = answers.where("i < 1000000")
    assert {r["i"] for r in review.collapse_units(items, half).collect()} == {1}


def test_alignment(spark):
    unit = "track_id int, seq int, text string, start double, end double"
    blocks = spark.createDataFrame([(1, 0, "山川", None, None), (1, 1, "海風", None, None), (2, 0, "x", 5.0, 6.0)], unit)
    chars = spark.createDataFrame([(1, 0, "山", 0.0, 0.5), (1, 1, "川", 0.5, 1.0), (1, 2, "海", 2.0, 2.5), (1, 3, "風", 2.5, 3.0)], unit)
    assert {(r["track_id"], r["seq"]): (r["start"], r["end"]) for r in align.route_blocks(blocks, chars).collect()} == {(1, 0): (0.0, 1.0), (1, 1): (2.0, 3.0), (2, 0): (5.0, 6.0)}
    texts = spark.createDataFrame([(1, "zh", "山川，海風。"), (2, "en", "Boats—oars, sails")], "track_id int, lang string, text string")
    more = chars.unionByName(spark.createDataFrame([(2, 0, "boats", 0.0, 1.0), (2, 1, "oars", 1.5, 2.0), (2, 2, "sails", 3.0, 4.0)], unit))
    got = {}
    for r in align.reinject_punctuation(texts, more).orderBy("track_id", "seq").collect():
        got.setdefault(r["track_id"], []).append((r["text"], r["start"], r["end"]))
    assert got[1] == [("山", 0.0, 0.5), ("川", 0.5, 1.0), ("，", 1.0, 1.0), ("海", 2.0, 2.5), ("風", 2.5, 3.0), ("。", 3.0, 3.0)]
    assert got[2] == [("Boats—", 0.0, 1.0), ("oars,", 1.5, 2.0), ("sails", 3.0, 4.0)]
    rows = [("two tall ships at anchor", "Two tall ships, at anchor.", "en"), ("keep, the rope", "mud flats.", "en"), ("", "tide.", "en"), ("山川海風", "山川，海風。", "zh"), ("deck", "deck", "en"), ("a, b. c", "a b! c", "en"), ("wind", "?! wind", "en"), (None, None, None)]
    fused = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "track_id int, seq int, text string, other string, lang string")
    got = [r["fused"] for r in align.fuse_punctuation(fused).orderBy("seq").collect()]
    assert got == ["two tall ships, at anchor.", "keep, the rope", "tide.", "山川，海風。", "deck", "a b! c", "?!wind", ""]


def test_speakers(spark):
    cases = [("ABA", [1.0, 0.15, 1.0], "AAA"), ("AB", [1.0, 0.16], "AB"), ("AB", [1.0, 0.08], "AA"), ("ABC", [1.0, 0.15, 1.0], "ABC"), ("ABC", [1.0, 0.1, 2.0], "ACC"), ("BAAB", [0.05, 0.04, 0.05, 0.5], "AAAB"), ("A", [0.0], "A"), ("ABABA", [0.3, 0.11, 0.19, 0.1, 0.3], "AAAAA")]
    rows = spark.createDataFrame([(k, list(zip(labels, lengths))) for k, (labels, lengths, _) in enumerate(cases)], "k int, words array<struct<speaker:string,length:double>>")
    got = {r["k"]: "".join(r["labels"]) for r in rows.select("k", speakers.absorb_tiny_runs(F.col("words")).alias("labels")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}
    cue = [(1, 0, 0.0, 4.0, "row on then rest", "en", False, [{"start": 0.0, "end": 4.0}]), (1, 1, 5.0, 6.0, "solo", "en", False, [{"start": 5.0, "end": 6.0}])]
    cues = spark.createDataFrame(cue, "track_id int, seq int, start double, end double, text string, lang string, lyric boolean, word_data array<struct<start:double,end:double>>")
    words = spark.createDataFrame([(1, 0, 0, "row", 0.0, 1.0), (1, 0, 1, "on", 1.0, 2.0), (1, 0, 2, "then", 2.0, 3.0), (1, 0, 3, "rest", 3.0, 4.0), (1, 1, 0, "solo", 5.0, 6.0)], "track_id int, cue int, k int, text string, start double, end double")
    turns = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 9.0, "B")], "track_id int, seq int, start double, end double, speaker string")
    got = speakers.format_speakers(cues, words, turns).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["-row on\n-then rest", "solo"]
    got = speakers.format_speakers(cues.withColumn("lang", F.lit("zh")), words, turns).orderBy("seq").collect()
    assert [(r["text"], r["start"], r["end"]) for r in got] == [("rowon", 0.0, 2.0), ("thenrest", 2.0, 4.0), ("solo", 5.0, 6.0)]


def test_paths(spark):
    edges = spark.createDataFrame([(1, 0, s, d) for s, d in [(0, 1), (0, 2), (1, 4), (2, 3), (3, 4), (2, 4), (1, 2)]], "track_id int, window int, src int, dst int")
    got = semantic.fewest_cues(edges).first()
    assert (got["breaks"], got["cues"]) == ([1], 2)
    path = lambda q: spark.createDataFrame([(1, a, b, x) for (a, b), x in q], "track_id int, src int, dst int, quality int")
    base, good, bad = path([((0, 2), 80), ((2, 4), 80)]), path([((0, 1), 70), ((1, 4), 70)]), path([((0, 1), 10), ((1, 4), 70)])
    assert {r["source"] for r in semantic.whole_or_baseline(base, good).collect()} == {"candidate"}
    assert {r["source"] for r in semantic.whole_or_baseline(base, bad).collect()} == {"baseline"}
    assert tuple(metrics.path_quality(bad).first())[1:] == (55.0, 10)
    options = spark.createDataFrame([(1, 0, 0, True, 0.0, 0.0, 0.0, 0.0), (1, 0, 1, False, 0.1, 0.2, 0.0, 0.0), (2, 0, 0, True, 0.0, 0.0, 0.0, 0.0), (2, 0, 1, False, 0.5, 0.3, 0.0, 0.1)], "track_id int, window int, option int, fallback boolean, logit_a double, logit_b double, timing double, host double")
    assert {r["track_id"]: r["option"] for r in semantic.choose_option(options).collect()} == {1: 0, 2: 1}
    many = options.where("track_id = 2").withColumn("cues", F.when(F.col("fallback"), 3).otherwise(4))
    pick = lambda f: semantic.choose_option(f).first()["option"]
    assert pick(many) == 1 and pick(many.withColumn("cues", F.when(F.col("fallback"), 3).otherwise(5))) == 0
    graded = many.withColumn("quality", F.when(F.col("fallback"), 80.0).otherwise(75.0)).withColumn("worst", F.when(F.col("fallback"), 60).otherwise(50))
    assert pick(graded) == 1 and pick(graded.withColumn("quality", F.when(F.col("fallback"), 80.0).otherwise(74.9))) == 0 and pick(graded.withColumn("worst", F.when(F.col("fallback"), 60).otherwise(49))) == 0


def test_streaming_spans(spark, tmp_path):
    rows = spark.sql("select id % 3 track_id, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * (1 + id div 10)) ts from range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    batch = streaming.session_spans(rows, "5 seconds")
    q = streaming.session_spans(stream, "5 seconds").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, batch.collect()))


def test_streaming_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 4.0), (1, 5.0, 9.0), (1, 10.0, 14.0), (1, 15.0, 40.0)], "track_id long, start double, end double").withColumn("ts", F.timestamp_seconds(F.col("start") + 1_700_000_000))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.pack_stream(stream, 10.0).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted((r["start"], r["end"]) for r in spark.table("chunks").collect()) == [(0.0, 9.0), (10.0, 14.0), (15.0, 25.0), (25.0, 35.0)]


def test_edges_are_looked_up_and_not_joined(spark):
    """Words of many windows, wider than the budget or without times; no pairs of a window are made that do not fit."""
    words = [(t, k // 50, k, "ab" * (1 + k % 5), float(k), None if k % 40 == 7 else k + 0.5) for t in (1, 2) for k in range(400)]
    frame = spark.createDataFrame(words, "track_id int, window int, seq int, text string, start double, end double")
    edges = semantic.legal_edges(frame, F.lit(30), 6.0)
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    want = set()
    for t, w, a, _, start, _ in words:
        for _, _, b, _, _, end in words[a : w * 50 + 50]:
            chosen = [x[3] for x in words[a : b + 1]]
            if len(" ".join(chosen)) <= 30 and end is not None and end - start <= 6.0:
                want.add((t, w, a, b + 1, sum(map(len, chosen)), float(b + 1) if b < 399 else None))
    assert {tuple(r) for r in edges.select("track_id", "window", "src", "dst", "chars", "next_start").collect()} == want


def test_paths_need_no_join_where_edges_lie_in_order(spark):
    r = random.Random(7)
    rows = sorted({(t, w, a, a + r.randint(1, 4)) for t in range(5) for w in range(40) for a in range(w * 20, w * 20 + 15) for _ in range(2)})
    edges = spark.createDataFrame(rows, "track_id int, window int, src int, dst int")
    reach = lambda pairs, at: at if not (more := {b for a, b in pairs if a in at} - at) else reach(pairs, at | more)
    want = set()
    for key in {x[:2] for x in rows}:
        own = [x[2:] for x in rows if x[:2] == key]
        ahead, back = reach(own, {min(a for a, _ in own)}), reach([(b, a) for a, b in own], {max(b for _, b in own)})
        want |= {(*key, a, b) for a, b in own if a in ahead and b in back}
    for given, in_order in ((edges.coalesce(1), True), (edges.repartition(3), False)):
        got = semantic.on_complete_paths(given, in_order)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(x) for x in got.collect()} == want
        assert semantic.fewest_cues(given, in_order).count() == 200
