"""What plans hold: shuffles, and expressions that are worked out more than once."""

from pyspark.sql import functions as F

from cuegrid.operators import intervals as iv
from cuegrid.operators import speakers
from cuegrid.plans import replay, streams
from cuegrid.sources import subtitles


def planned(df, simple=True):
    execution = df._jdf.queryExecution()
    return execution.optimizedPlan().toString() if simple else execution.executedPlan().toString()


def documents(spark):
    text = " ".join(["One two,", "three four. Five"] * 40)
    return spark.createDataFrame([(i, "en", text) for i in range(30)], "doc_id long, lang string, text string")


def test_words_of_texts_are_shuffled_as_texts(spark):
    """The one exchange lies below the words, and cues need no other."""
    cues = replay.cues_from_words(streams.word_stream(documents(spark)))
    plan = planned(cues, simple=False)
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > plan.index("Generate posexplode")
    assert cues.count() == 30 * 41


def test_parsing_does_not_repeat_its_expressions(spark):
    files = spark.createDataFrame([(1, "WEBVTT\n\n00:01.000 --> 00:02.000\na b\n\n00:03.000 --> 00:04.000\nc\n")], "track_id long, text string").repartition(2)
    cues = subtitles.parse_vtt(files)
    assert [tuple(r) for r in cues.select("seq", "start", "end", "text").orderBy("seq").collect()] == [(0, 1.0, 2.0, "a b"), (1, 3.0, 4.0, "c")]
    assert planned(cues).count("regexp_replace(") < 30


def test_cues_over_batches_with_gaps_in_their_values(spark):
    """Batches of two words; languages that alternate in a cue, words without text or time."""
    rows = [(1, 0, "en", "a", 0.0, 1.0, 0), (1, 1, "ja", "b", 1.0, 2.0, 0), (1, 2, "en", None, None, 5.0, 0), (1, 3, "en", "c", 3.0, None, 0), (1, 4, "en", "d", 9.0, 9.5, 1), (2, 0, "ja", "e", None, None, 0), (2, 1, "ja", "f", None, None, 0)]
    words = spark.createDataFrame(rows, "track_id long, seq int, lang string, text string, start double, end double, cue long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = replay.cues_of(words).select("track_id", "seq", "lang", "text", "start", "end", F.size("word_data")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(1, 0, "en", "a c", 0.0, 5.0, 3), (1, 0, "ja", "b", 1.0, 2.0, 1), (1, 1, "en", "d", 9.0, 9.5, 1), (2, 0, "ja", "ef", None, None, 2)]


def test_labels_of_words_move_them_twice(spark):
    """To the turns near them, and to their cues; snapping to phrases does not move them again."""
    words = streams.word_stream(documents(spark)).select("track_id", (F.col("seq") / 9).cast("int").alias("cue"), (F.col("seq") % 9).alias("k"), "text", "start", "end")
    turns = words.groupBy("track_id", F.floor(F.col("start") / 2).alias("seq")).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("speaker", F.when(F.col("seq") % 2 == 0, "A").otherwise("B"))
    labelled = speakers.label_words(words, turns, bucket_s=4.0)
    before = planned(labelled, simple=False).count("Exchange hashpartitioning")
    snapped = speakers.snap_to_phrases(labelled.withColumn("phrase", F.floor(F.col("k") / 3)))
    assert planned(snapped, simple=False).count("Exchange hashpartitioning") == before
    assert "SortAggregate" not in planned(labelled.where("end - start < 4"), simple=False).split("Union")[0]
    assert snapped.where("speaker is null").isEmpty()


def test_dominant_labels_do_not_depend_on_buckets(spark):
    """Spans within a bucket, over two and over many, ties and turns without a speaker."""
    spans = [(1, k, k * 0.7, k * 0.7 + (0.5, 2.5, 30.0, 0.0)[k % 4]) for k in range(60)] + [(1, 90, None, 1.0), (2, 0, 0.0, 9.0), (1, 91, 4.0, 2.0)]
    turns = [(1, k, k * 1.5, k * 1.5 + (1.0, 4.0)[k % 2], ("A", "B", None)[k % 3]) for k in range(25)] + [(1, 40, 3.0, None, "C"), (1, 41, 6.0, 5.0, "C")]
    a, b = spark.createDataFrame(spans, "track_id int, seq int, start double, end double"), spark.createDataFrame(turns, "track_id int, seq int, start double, end double, speaker string")

    def plain(s, e):
        if s is None or e <= s:
            return None
        sums = {}
        for _, n, x, y, who in sorted((t for t in turns if t[3] is not None), key=lambda t: (t[2], t[3], t[1])):
            if min(e, y) - max(s, x) > 0:
                sums[who] = sums.get(who, 0.0) + min(e, y) - max(s, x)
        return max(sums, key=lambda w: round(sums[w], 6)) if sums and round(max(sums.values()), 6) >= 0.05 else None

    want = {(t, n): plain(s, e) if t == 1 else None for t, n, s, e in spans}
    for bucket_s in (1.0, 3.0, 1000.0):
        assert {(r["track_id"], r["seq"]): r["speaker"] for r in iv.dominant_label(a, b, bucket_s=bucket_s).collect()} == want
