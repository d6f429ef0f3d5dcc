"""Particle repair against the rule spelled out in plain loops."""

import random

import pytest

from cuegrid.functions.layout import end_penalty, fits, start_penalty, width
from cuegrid.operators import particles
from cuegrid.plans import replay

CUE = "track_id int, seq int, lang string, text string, start double, end double, word_data array<struct<start:double,end:double>>"


def plain(cues, line, lines, max_s, connected_s):
    """Every edge in order; back by one after a merge."""
    work, i = [dict(c) for c in cues], 0
    while i + 1 < len(work):
        a, b = work[i], work[i + 1]
        text, units = a["text"] + b["text"], a["word_data"] + b["word_data"]
        pause = b["word_data"][0]["start"] - a["word_data"][-1]["end"]
        cut = len(a["text"])

        def score(k):
            hard = 3 * (end_penalty(text[k - 1], a["lang"]) + start_penalty(text[k], a["lang"]))
            ms = max(0.0, (units[k]["start"] - units[k - 1]["end"]) * 1000)
            quick = 3 if ms < 40 else 2 if ms < 120 else 1 if ms < 220 else 0
            small = min(width(text[:k]), width(text[k:]))
            return hard, quick + (8 if small <= 1 else 4 if small <= 2 else 0), abs(width(text[:k]) - width(text[k:])), -k

        bad = end_penalty(text[cut - 1], a["lang"]) >= 2 or start_penalty(text[cut], a["lang"]) >= 2
        if not bad or not -1e-6 <= pause < connected_s:
            i += 1
            continue
        if b["end"] - a["start"] <= max_s + 1e-9 and fits(text, line, lines, a["lang"]):
            work[i : i + 2] = [a | {"text": text, "end": b["end"], "word_data": units}]
            i = max(0, i - 1)
            continue
        legal = [
            k
            for k in range(1, len(text))
            if score(k) < score(cut) and all(fits(t, line, lines, a["lang"]) for t in (text[:k], text[k:])) and units[k - 1]["end"] - units[0]["start"] <= max_s and units[-1]["end"] - units[k]["start"] <= max_s
        ]
        if legal:
            k = min(legal, key=score)
            work[i : i + 2] = [a | {"text": text[:k], "end": units[k - 1]["end"], "word_data": units[:k]}, b | {"text": text[k:], "start": units[k]["start"], "word_data": units[k:]}]
        i += 1
    return work


def tracks(r, n):
    out = {}
    for t in range(n):
        lang = r.choice(["ja", "zh", "yue", "en"])
        alphabet = {"ja": "のをにと空青海が見、", "en": "abc "}.get(lang, "的地得我们了吗目中，")
        at, cues = 0.0, []
        for _ in range(r.randrange(1, 9)):
            text = "".join(r.choices(alphabet.strip(), k=r.randrange(1, 9)))
            units = []
            for _ in text:
                units.append({"start": at, "end": at + 0.2})
                at += 0.2 + r.choice([0.0, 0.0, 0.05, 0.15, 0.25])
            cues.append({"lang": lang, "text": text, "start": units[0]["start"], "end": units[-1]["end"], "word_data": units})
            at += r.choice([0.0, 0.0, 0.1, 0.5])
        out[t] = cues
    return out


def test_particles_equal_plain(spark):
    r = random.Random(2)
    found = tracks(r, 200)
    rows = [(t, k, c["lang"], c["text"], c["start"], c["end"], [(u["start"], u["end"]) for u in c["word_data"]]) for t, cs in found.items() for k, c in enumerate(cs)]
    out, merged, moved = {}, 0, 0
    for x in particles.mend_particles(spark.createDataFrame(rows, CUE), 5, 1, 7.0).orderBy("track_id", "seq").collect():
        out.setdefault(x["track_id"], []).append((x["text"], x["start"], x["end"], len(x["word_data"])))
    for t, cs in found.items():
        want = plain(cs, 5, 1, 7.0, 0.3) if cs[0]["lang"] != "en" else cs
        assert out[t] == [(c["text"], c["start"], c["end"], len(c["word_data"])) for c in want], t
        merged += len(want) < len(cs)
        moved += [c["text"] for c in want] != [c["text"] for c in cs] and len(want) == len(cs)
        assert "".join(c["text"] for c in want) == "".join(c["text"] for c in cs)
    assert merged > 20 and moved > 20


def cue(text, at, phrases=None, lang="ja"):
    units = [{"start": at + 0.2 * k, "end": at + 0.2 * k + 0.2} for k in range(len(text))]
    return {"lang": lang, "text": text, "start": at, "end": at + 0.2 * len(text), "word_data": units, "phrases": phrases}


def test_phrases_narrow_the_cut_and_move_along():
    left, right = cue("空はとても青い海", 0.0, [0, 2, 5]), cue("を見ましたよ", 1.6, [1])
    two = particles.mended(left, right, 9, 1, 7.0, 0.3)
    assert [(c["text"], c["phrases"]) for c in two] == [("空はとても", [0, 2]), ("青い海を見ましたよ", [3, 4])]
    one = particles.mended(cue("海", 0.0, []), cue("を見た", 0.2, [1]), 9, 1, 7.0, 0.3)
    assert one[0]["text"] == "海を見た" and one[0]["phrases"] == [1, 2]


@pytest.mark.parametrize(("left", "right"), [(cue("海", 0.0), cue("を見た", 5.0)), (cue("海だ", 0.0), cue("見た", 0.4)), ({**cue("海", 0.0), "word_data": []}, cue("を見た", 0.2)), ({**cue("海だよ", 0.0), "word_data": [{"start": 0.0, "end": 0.2}]}, cue("を見た", 0.2))])
def test_pauses_whole_edges_and_other_units_stay(left, right):
    assert particles.mended(left, right, 9, 1, 7.0, 0.3) is None


def test_the_first_step_of_the_polish(spark):
    a, b = cue("海", 0.0), cue("を見た", 0.2)
    rows = [(1, k, "ja", c["text"], c["start"], c["end"], [(u["start"], u["end"]) for u in c["word_data"]], False) for k, c in enumerate((a, b))]
    out = replay.full_polish(spark.createDataFrame(rows, CUE + ", lyric boolean")).collect()
    assert [x["text"] for x in out] == ["海を見た"]
    assert particles.mend_particles(spark.createDataFrame([], CUE), 9, 1, 7.0).count() == 0
