"""Packing of words into cues."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import layout
from cuegrid.functions import text as tx
from cuegrid.operators import folds, packing, timing
from cuegrid.plans import replay

WORD = "track_id int, seq int, lang string, text string, start double, end double"


def stream(words, gap=0.1, breaks=()):
    at, out = 0.0, []
    for k, w in enumerate(words):
        at += 0.5 if k in breaks else gap
        out.append({"text": w, "start": at, "end": at + 0.2, "brk": False})
        at += 0.2
    return out


def test_cut_avoids_hanging_words():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen went to the store and bought some bread there"
    words = text.split()
    sizes = packing.cue_sizes(stream(words), "en", 1e9)
    assert sum(sizes) == len(words) and len(sizes) > 1
    at = 0
    for n in sizes[:-1]:
        at += n
        assert layout.end_penalty(words[at - 1], "en") == 0
    late = packing.cue_sizes(stream(["word"] * 60), "en", 5.0)
    assert sum(late) == 60 and max(late) * 0.3 <= 5.3


@pytest.mark.parametrize("seed", range(4))
def test_cues_fit_and_keep_all_words(seed):
    r = random.Random(seed)
    for lang in ("en", "de", "zh"):
        words = ["".join(r.choices("字語文的了" if lang == "zh" else "abcdef", k=1 if lang == "zh" else r.randint(1, 11))) for _ in range(120)]
        sizes = packing.cue_sizes(stream(words), lang, 1e9)
        assert sum(sizes) == 120
        at, sep = 0, "" if lang == "zh" else " "
        for n in sizes:
            assert layout.fits(sep.join(words[at : at + n]), *packing.budget(lang), lang)
            at += n


def test_start_penalty_equals_column(spark):
    cases = [(w, g) for w in ("了", "了解", "、a", "の", "で", "ok", "") for g in ("zh", "ja", "en")]
    frame = spark.createDataFrame(cases, "w string, g string").select(tx.line_start_penalty(F.col("w"), F.col("g")).alias("p"))
    assert [r["p"] for r in frame.collect()] == [packing.start_penalty(*c) for c in cases]


def test_sticky_pause_does_not_break(spark):
    rows = [(1, 0, "en", "the", 0.0, 0.2), (1, 1, "en", "cat", 0.95, 1.2), (1, 2, "en", "sat", 1.95, 2.2), (1, 3, "en", "the", 2.3, 2.5), (1, 4, "en", "end", 4.0, 4.2)]
    words = spark.createDataFrame(rows, WORD)
    flagged = timing.break_flags(words, F.lit(400), F.lit(1000), F.lit(700))
    free = packing.unstick(flagged, F.col("lang"), F.lit(400), F.lit(1000))
    assert [r["brk"] for r in free.orderBy("seq").collect()] == [False, False, True, False, True]
    cues = replay.segmented(words).orderBy("seq").collect()
    assert [c["text"] for c in cues] == ["the cat", "sat the", "end"]
    done = replay.full_polish(replay.segmented(words)).orderBy("seq").collect()
    assert " ".join(c["text"] for c in done).split() == [r[3] for r in rows]


def test_a_long_track_is_packed_in_stretches(spark):
    r = random.Random(3)
    tracks = {t: [x | {"brk": r.random() < 0.1} for x in stream(["".join(r.choices("abcdef", k=r.randint(1, 9))) for _ in range(n)])] for t, n in ((1, 400), (2, 1), (3, 60))}
    rows = [(t, k, "en", x["text"], x["start"], x["end"], x["brk"]) for t, v in tracks.items() for k, x in enumerate(v)]
    out = packing.pack_cues(spark.createDataFrame(rows, WORD + ", brk boolean"))
    assert "_block" in str(out._jdf.queryExecution().analyzed()).split("RepartitionByExpression", 1)[1].split("]")[0]
    got = {(x["track_id"], x["seq"]): x["cue"] for x in out.collect()}
    for t, v in tracks.items():
        want = [k for k, n in enumerate(packing.cue_sizes(v, "en", 7.0)) for _ in range(n)]
        assert [got[t, k] for k in range(len(v))] == want


def plain_chunks(segments, most):
    out, held = [], None
    for s, e in sorted(segments):
        if held and e - held[0] <= most:
            held[1] = e
            continue
        out += [tuple(held)] if held else []
        held = [s, e]
        while e - s > most:
            out.append((s, s + most))
            s, held = s + most, None
            if e - s <= most:
                out.append((s, e))
    return out + ([tuple(held)] if held else [])


def test_segments_far_apart_are_folded_apart(spark):
    r = random.Random(5)
    tracks = {t: [(a, a + r.choice([0, 1, 4, 30])) for a in (r.randrange(0, 3000) for _ in range(120))] for t in range(20)}
    frame = spark.createDataFrame([(t, float(a), float(b)) for t, v in tracks.items() for a, b in v], "track_id int, start double, end double")
    out = folds.pack_segments(frame, 12.0)
    got = {t: [] for t in tracks}
    for x in out.orderBy("track_id", "chunk_no").collect():
        assert x["chunk_no"] == len(got[x["track_id"]])
        got[x["track_id"]].append((x["start"], x["end"]))
    assert got == {t: plain_chunks(v, 12.0) for t, v in tracks.items()}


def test_wide_cues_wait_for_a_phrase():
    words = stream(["lantern"] * 30)
    for k, w in enumerate(words):
        w["phrase"] = k % 13 == 0
    sizes = packing.cue_sizes(words, "en", 1e9)
    assert sizes == [13, 13, 4]
    for w in words:
        w["phrase"] = False
    sizes = packing.cue_sizes(words, "en", 1e9)
    assert sum(sizes) == 30 and len(sizes) > 1 and max(sizes) * 8 <= 1.5 * 84 + 8


def test_pieces_of_long_tracks(spark):
    r, rows, want = random.Random(8), [], {}
    for t in range(12):
        at, own = 0.0, []
        for k in range(r.choice([1, 40, 300])):
            at += r.choice([0.1, 0.1, 0.5, 2.0, 5.0])
            own.append((at, at + 1.0))
            at += 1.0
        rows += [(t, k, "en", "x", a, b) for k, (a, b) in enumerate(own)]
        opens = [k for k in range(1, len(own)) if own[k][0] - max(b for _, b in own[:k]) >= 2.0]
        start, cuts = 0, []
        while own[-1][1] - own[start][0] > 60.0:
            near = [k for k in opens if k > start and own[k][0] - own[start][0] <= 60.0]
            far = [k for k in opens if k > start]
            if not far:
                break
            start = near[-1] if near else far[0]
            cuts.append(start)
        want |= {(t, k): sum(c <= k for c in cuts) for k in range(len(own))}
    got = {(x["track_id"], x["seq"]): x["piece"] for x in replay.pieces_of_tracks(spark.createDataFrame(rows, WORD), 60.0).collect()}
    assert got == want and max(want.values()) > 2


def test_packing_moves_and_reads_words_once(spark):
    """Stretches, cues and languages carried over the edges of batches; one exchange, no join."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(t, k, "en" if k else lang, "word" + "s" * (k % 9), float(k), k + 0.5, k % 11 == 0 and k > 0) for t, lang in ((1, "en"), (2, "ja"), (3, "de")) for k in range(60)]
        flagged = spark.createDataFrame(rows, WORD + ", brk boolean").repartition(3)
        out = packing.pack_cues(flagged, 20.0, by_track=True)
        plan = replay.cues_of(out, in_order=True)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("hashpartitioning") == 1
        got = {(r["track_id"], r["seq"]): r["cue"] for r in out.collect()}
        cues = {(r["track_id"], r["seq"]): r["text"] for r in replay.cues_of(out, in_order=True).select("track_id", "seq", "text").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for t, lang in ((1, "en"), (2, "ja"), (3, "de")):
        words = [dict(zip(("text", "start", "end", "brk"), r[3:], strict=True)) for r in rows if r[0] == t]
        sizes = packing.cue_sizes(words, lang, 20.0)
        want = [c for c, n in enumerate(sizes) for _ in range(n)]
        assert [got[t, k] for k in range(60)] == want
        assert sorted(s for u, s in cues if u == t) == sorted(set(want))


def test_mending_and_merging_visit_cues_once(spark):
    """Cues that need nothing pass beside those that are changed, in order, over the edges of batches; nothing is read twice."""
    from cuegrid.operators import folds, particles

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cue = "track_id long, seq int, lang string, text string, start double, end double, word_data array<struct<start:double,end:double>>"
        rows = [(t, k, None if t == 2 else "zh" if t == 0 else "en", "好的" if t == 0 else f"w{k}", 1.0 * k + (9 if k > 4 else 0), 1.0 * k + (9 if k > 4 else 0) + 0.9, [(k + 0.0, k + 0.4), (k + 0.4, k + 0.9)]) for t in range(4) for k in range(10)]
        cues = spark.createDataFrame(rows, cue).repartition(2)
        for out in (particles.mend_particles(cues, 9, 1, 7.0), folds.merge_micro(cues, 0.5, 12, 7.0)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Union" not in plan and plan.count("hashpartitioning") == 1
            for t in range(4):
                got = [r for r in out.where(f"track_id = {t}").orderBy("seq").collect()]
                assert [r["seq"] for r in got] == list(range(len(got)))
                assert "".join(r["text"] for r in got).replace(" ", "") == "".join(r[3] for r in rows if r[0] == t)
                assert sum(len(r["word_data"]) for r in got) == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
