"""Interval algebra: fixed cases, and random tracks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import intervals as iv
from cuegrid.operators.folds import pack_segments
from cuegrid.plans import songs

SPAN = "track_id long, seq long, start double, end double"


def spans(spark, rows):
    """rows: {track: [(start, end), ...]}"""
    flat = [(t, k, float(a), float(b)) for t, v in rows.items() for k, (a, b) in enumerate(v)]
    return spark.createDataFrame(flat, SPAN)


def by_track(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["track_id"], []).append(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns))
    return {t: sorted(v, key=str) for t, v in out.items()}


def clean(rows):
    return {t: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in v], key=str) for t, v in rows.items() if v}


def random_spans(r, n, disjoint=False):
    cut = sorted(r.randrange(0, 240) / 4 for _ in range(2 * n))
    if disjoint:
        return [(a, b) for a, b in zip(cut[::2], cut[1::2]) if b > a]
    out = [(a, a + r.randrange(1, 24) / 4) for a in cut[:n]]
    return sorted(out)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(11)
    return {t: (random_spans(r, r.randrange(0, 9)), random_spans(r, r.randrange(0, 7)), random_spans(r, r.randrange(0, 5), True)) for t in range(150)}


def side(cases, k):
    return {t: c[k] for t, c in cases.items()}


def minus(a, b, cover):
    out, at = [], a
    for s, e in sorted(cover):
        if e <= at or s >= b:
            continue
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return out + ([(at, b)] if at < b else [])


def union(v):
    out = []
    for a, b in sorted(v):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@pytest.mark.parametrize("times, want", [([0, 1, 2], [(0.0, 4.0)]), ([0, 1, 6, 7], [(0.0, 3.0), (6.0, 9.0)]), ([5], [])])
def test_windows_to_spans(spark, times, want):
    w = spark.createDataFrame([(1, float(t), True) for t in times] + [(1, 3.0, False)], "track_id long, t double, flag boolean")
    assert by_track(iv.flagged_windows_to_spans(w), "start", "end") == clean({1: want})


def test_union_complement_difference(spark, cases):
    a, b = spans(spark, side(cases, 0)), spans(spark, side(cases, 1))
    assert by_track(iv.coalesce_spans(a), "start", "end") == clean({t: union(c[0]) for t, c in cases.items()})
    want = {t: [(s, e) for s, e in minus(0.0, max([x for _, x in c[0]], default=0), c[0])] for t, c in cases.items()}
    assert by_track(iv.silence_gaps(a), "start", "end") == clean(want)
    for bucket in (30.0, 2.0):
        got = by_track(iv.subtract_spans(a, b, bucket), "seq", "start", "end")
        assert got == clean({t: [(k, *p) for k, (s, e) in enumerate(c[0]) for p in minus(s, e, c[1])] for t, c in cases.items()})


def test_semi_and_anti_join(spark, cases):
    a, b = spans(spark, side(cases, 0)), spans(spark, side(cases, 1))
    hit = {t: [(k,) for k, (s, e) in enumerate(c[0]) if any(min(e, y) - max(s, x) > 0.5 for x, y in c[1])] for t, c in cases.items()}
    assert by_track(iv.overlapping(a, b, 0.5, 3.0), "seq") == clean(hit)
    miss = {t: [(k,) for k in range(len(c[0])) if (k,) not in hit[t]] for t, c in cases.items()}
    assert by_track(iv.not_overlapping(a, b, 0.5, 3.0), "seq") == clean(miss)


def snap(c, silences, reach=1.5):
    best = c, None
    for a, b in silences:
        if a <= c <= b:
            return c
        p = min(max((a + b) / 2, c - reach), c + reach)
        if a <= p <= b and (best[1] is None or abs(p - c) < best[1]):
            best = p, abs(p - c)
    return best[0]


def excise(segments, cuts, silences, keep=0.4):
    if not cuts or not segments:
        return segments, cuts
    moved = []
    for a, b in cuts:
        x, y = snap(a, silences), snap(b, silences)
        moved.append((x, y) if y > x else (a, b))
    moved = union(moved)
    return [p for s, e in segments for p in minus(s, e, moved) if p[1] - p[0] >= keep], moved


def test_snap_and_excise(spark, cases):
    points = spark.createDataFrame([(t, k, s) for t, c in cases.items() for k, (s, _) in enumerate(c[0])], "track_id long, seq long, t double")
    silences = spans(spark, side(cases, 2))
    got = by_track(iv.snap_to_silence(points, silences), "seq", "snapped")
    assert got == clean({t: [(k, snap(s, c[2])) for k, (s, _) in enumerate(c[0])] for t, c in cases.items()})
    kept, cut = iv.excise_spans(spans(spark, side(cases, 0)), spans(spark, side(cases, 1)).drop("seq"), silences)
    want = {t: excise(c[0], c[1], c[2]) for t, c in cases.items()}
    assert by_track(kept, "start", "end") == clean({t: w[0] for t, w in want.items()})
    assert by_track(cut, "start", "end") == clean({t: w[1] for t, w in want.items()})


def over(a, b, v):
    return any(max(a, x) < min(b, y) for x, y in v)


def grow(segments, cuts, live, protect, gap=3.0, core_gap=15.0):
    if not cuts or not segments:
        return cuts
    blocks = []
    for s in segments:
        if blocks and s[0] - blocks[-1][-1][1] <= gap:
            blocks[-1].append(s)
        else:
            blocks.append([s])
    clusters = []
    for s in sorted(cuts):
        if clusters and s[0] - max(e for _, e in clusters[-1]) <= core_gap:
            clusters[-1].append(s)
        else:
            clusters.append([s])
    cores = [s for c in clusters if any(over(*s, live) for s in c) for s in c]
    out = list(cuts)
    for blk in blocks:
        if over(blk[0][0], blk[-1][1], live):
            dirty = [s for s in blk if not (over(*s, protect) and not over(*s, cores))]
            if dirty:
                out.append((dirty[0][0], dirty[-1][1]))
    return union(out)


def test_block_expansion(spark, cases):
    r = random.Random(5)
    live = {t: [s for s in c[1] if r.random() < 0.4] for t, c in cases.items()}
    got = iv.expand_to_voiced_blocks(spans(spark, side(cases, 0)), spans(spark, side(cases, 1)), spans(spark, live), spans(spark, side(cases, 2)))
    want = {t: union(grow(c[0], c[1], live[t], c[2])) for t, c in cases.items()}
    assert by_track(got, "start", "end") == clean(want)


def test_groups_and_song_plan(spark, cases):
    grouped = by_track(iv.group_by_spans(spans(spark, side(cases, 0)), spans(spark, side(cases, 2))), "seq", "grp")
    want = {}
    for t, c in cases.items():
        g = 0
        for k, (s, _) in enumerate(c[0]):
            if k and over(c[0][k - 1][1], s, c[2]):
                g += 1
            want.setdefault(t, []).append((k, g))
    assert grouped == clean(want)


def test_dialogue_around_a_song_survives(spark):
    one = lambda *v: spans(spark, {1: list(v)})
    plan = songs.plan_song_skip(one((112, 117)), one((112, 117)), one((95, 99), (100, 130)), one((100, 111), (118, 130)), one((111.7, 112.1), (117.2, 117.6)), 8.0, 120.0)
    assert by_track(plan["cut"], "start", "end") == clean({1: [(112.0, 117.4)]})
    assert by_track(plan["kept"], "start", "end") == clean({1: [(95.0, 99.0), (100.0, 112.0), (117.4, 130.0)]})


def test_music_alone_cuts_nothing(spark):
    one = lambda *v: spans(spark, {1: list(v)})
    plan = songs.plan_song_skip(one((148, 151)), one(), one((148.5, 156.3)), one(), one())
    assert plan["cut"].count() == 0
    assert by_track(plan["chunks"], "start", "end") == clean({1: [(148.5, 156.3)]})


@pytest.mark.parametrize(
    "given, most, want",
    [
        ([(0, 100), (101, 201), (202, 302)], 240, [(0, 201), (202, 302)]),
        ([(0, 500)], 240, [(0, 240), (240, 480), (480, 500)]),
        ([(0, 10), (11, 300), (301, 310)], 100, [(0, 10), (11, 111), (111, 211), (211, 300), (301, 310)]),
    ],
)
def test_pack_segments(spark, given, most, want):
    got = pack_segments(spans(spark, {1: given}), most).orderBy("chunk_no").collect()
    assert [(r["start"], r["end"]) for r in got] == want and [r["chunk_no"] for r in got] == list(range(len(want)))


def test_sound_events(spark):
    rows = [(1, 0.0, [0.1, 0.8, 0.0]), (1, 1.0, [0.9, 0.7, 0.0]), (1, 2.0, [0.9, 0.2, 0.9]), (1, 9.0, [0.9, 0.4, 0.4])]
    tags = spark.createDataFrame([(1, "explosion"), (2, "knocking")], "idx int, tag string")
    got = iv.sound_events(spark.createDataFrame(rows, "track_id long, t double, probs array<double>"), tags)
    assert by_track(got, "start", "end", "tag") == clean({1: [(0.0, 3.0, "explosion"), (2.0, 4.0, "knocking")]})


@pytest.mark.parametrize("event, cues, want", [((3, 8), [(0, 5), (8, 12)], [(5.0, 8.0)]), ((0, 30), [], [(0.0, 7.0)]), ((0, 5), [(0, 4.5)], [])])
def test_events_fit_between_cues(spark, event, cues, want):
    got = iv.fit_events_to_gaps(spans(spark, {1: [event]}), spans(spark, {1: cues}))
    assert by_track(got, "start", "end") == clean({1: want})


@pytest.mark.parametrize("turns, want", [([(0, 1, "A"), (1.2, 2, "A")], [(0.0, 2.0, "A")]), ([(0, 2, "A"), (0.5, 0.55, "B")], [(0.0, 2.0, "A")]), ([(0, 1, "A"), (1, 1.1, "B")], [(0.0, 1.0, "A"), (1.0, 1.1, "B")])])
def test_turn_smoothing(spark, turns, want):
    df = spark.createDataFrame([(1, k, float(a), float(b), s) for k, (a, b, s) in enumerate(turns)], SPAN + ", speaker string")
    assert by_track(iv.smooth_turns(df), "start", "end", "speaker") == clean({1: want})


def test_lyric_share_and_dominant_label(spark):
    cues = spans(spark, {1: [(0, 2), (10, 12), (5, 5)]})
    got = {r["seq"]: r["share"] for r in iv.covered_share(cues, spans(spark, {1: [(0.5, 3)]})).collect()}
    assert got == {0: 0.75, 1: 0.0, 2: None}
    turns = spark.createDataFrame([(1, 0, 0.0, 1.0, "B"), (1, 1, 1.0, 2.0, "A"), (1, 2, 11.97, 13.0, "A")], SPAN + ", speaker string")
    got = {r["seq"]: r["speaker"] for r in iv.dominant_label(cues, turns).collect()}
    assert got == {0: "B", 1: None, 2: None}


def test_nulls_and_empty(spark):
    odd = spark.createDataFrame([(1, 0, None, 1.0), (1, 1, 2.0, None), (1, 2, 3.0, 4.0), (None, 3, 0.0, 9.0)], SPAN)
    cover = spans(spark, {1: [(0, 9)]})
    assert [r["seq"] for r in iv.overlapping(odd, cover).collect()] == [2]
    none = cover.where("false")
    assert iv.coalesce_spans(none).count() == 0 and iv.subtract_spans(none, cover).count() == 0
    assert iv.subtract_spans(cover, none).count() == 1
    assert iv.within_spans(none.select("track_id", F.col("start").alias("t")), cover).count() == 0


def test_nearest_mark_is_found_without_pairs(spark):
    r = random.Random(5)
    points = [(t, k, None if k == 3 else r.randint(0, 200) / 8, f"p{k}") for t in (1, 2, 3, None) for k in range(60)]
    marks = [(t, None if k == 3 else r.randint(0, 200) / 8) for t in (1, 2, None) for k in range(40)]
    given = spark.createDataFrame(points, "track_id long, seq int, t double, more string"), spark.createDataFrame(marks, "track_id long, t double")
    out = iv.nearest_point(*given, 0.5)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    own = lambda t: [m for u, m in marks if u == t and t is not None and m is not None]
    want = {(t, k, at, more, min(((abs(m - at), m) for m in own(t) if at is not None and abs(m - at) <= 0.5), default=(0, None))[1]) for t, k, at, more in points}
    assert {tuple(x) for x in out.collect()} == want
