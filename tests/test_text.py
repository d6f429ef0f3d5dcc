"""Text functions against plain loops, and fixed cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import language as lg
from cuegrid.functions import layout
from cuegrid.functions import text as tx

LETTERS = "abI .,!?1 9 あのをと的 漢字ー한%％—…-　\n'\"♪é"


@pytest.fixture(scope="module")
def strings():
    r = random.Random(4)
    return ["", " ", "I I I think", "3.75 and 10,000", "92%的 GPT-4 model", *["".join(r.choices(LETTERS, k=r.randint(0, 30))) for _ in range(1500)]]


def column(spark, strings, make):
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(strings)], "k int, s string")
    return [r["v"] for r in frame.select("k", make(F.col("s")).alias("v")).orderBy("k").collect()]


def test_measures(spark, strings):
    assert column(spark, strings, tx.visual_width) == [layout.width(s) for s in strings]
    assert column(spark, strings, tx.reading_chars) == [sum(not c.isspace() for c in s) for s in strings]
    assert column(spark, strings, tx.content_mass) == [sum(c.isalnum() for c in s) for s in strings]
    assert column(spark, strings, tx.spaced_tokens) == [s.split() for s in strings]


def cjk_tokens(s):
    out = re.findall(r"[A-Za-z0-9._-]+(?:\s+[A-Za-z0-9._-]+)*|\S", s)
    merged = []
    for t in out:
        if merged and t in tx.UNIT_SIGNS and merged[-1][-1].isdigit():
            merged[-1] += t
        else:
            merged.append(t)
    return merged


def test_unspaced_tokens(spark, strings):
    assert column(spark, strings, tx.unspaced_tokens) == [cjk_tokens(s) for s in strings]


def test_strip_and_stutters(spark, strings):
    plain = lambda s: re.sub(r"\s+", " ", re.sub(rf"[.,](?![0-9])|[{tx.DROPPED}]", " ", s)).strip()
    assert column(spark, strings, tx.strip_punctuation) == [plain(s) for s in strings]
    assert column(spark, ["3.75 and 10,000", "I I I think", "well-known", "No no, no no"], tx.strip_punctuation) == ["3.75 and 10,000", "I I I think", "well-known", "No no no no"]
    assert column(spark, ["I I I think", "the the cat", "a b a b", "ja ja"], tx.merge_stutters) == ["I-I-I think", "the-the cat", "a b a b", "ja-ja"]
    assert column(spark, ["「はい」…yes—no", "a—b (c)"], tx.strip_for_translation) == ["はい yes no", "a b c"]


@pytest.mark.parametrize("word, lang, want", [("の", "ja", 2), ("を", "ja", 2), ("へ", "", 2), ("と", "ja", 1), ("まで", "ja", 1), ("the", "en", 2), ("The,", "en", 2), ("store", "en", 0), ("目的", "zh", 0), ("的", "zh", 2), ("在", "zh", 1), ("", "en", 0)])
def test_line_end_penalty(spark, word, lang, want):
    assert column(spark, [word], lambda c: tx.line_end_penalty(c, F.lit(lang))) == [want]
    assert layout.end_penalty(word, lang) == want


def test_line_start_and_break(spark):
    assert column(spark, ["了", "了解", "、x", "ok", ""], lambda c: tx.line_start_penalty(c, F.lit("zh"))) == [2, 0, 2, 0, 0]
    assert column(spark, ["の", "で", "です"], lambda c: tx.line_start_penalty(c, F.lit("ja"))) == [2, 1, 0]
    at = lambda lang, k: lambda c: tx.legal_break(tx.spaced_tokens(c), F.lit(lang), F.lit(k))
    assert column(spark, ["went to the store now", "the of"], at("en", 3)) == [4, 2]
    assert column(spark, ["went to the store now"], at("de", 3)) == [3]


def test_marks(spark):
    assert column(spark, ["♪ la ♪", "♪♪", "la"], tx.is_lyric) == [True, False, False]
    assert column(spark, ["♪ la ♪", "la"], tx.lyric_text) == ["la", "la"]
    assert column(spark, ["-a\n-b", "- a\n-b", "-a", "a\n-b", "-a\n-b\n-c", "-\n-b"], tx.is_dash_cue) == [True, True, False, False, False, False]
    assert column(spark, ["-a\n— b"], tx.dash_parts) == [["a", "b"]]
    assert column(spark, ["today—a", "—a", "a—", "x...y…z", "well-known", "a--b"], tx.split_at_breaks) == [["today—", "a"], ["—a"], ["a—"], ["x...", "y…", "z"], ["well-known"], ["a--", "b"]]
    assert column(spark, ["One. Two!Three？四。", ""], tx.sentences) == [["One.", "Two!", "Three？", "四。"], []]
    assert column(spark, ["end.\"", "...", "ok"], tx.strip_trailing_punctuation) == ["end", "...", "ok"]


def test_time_codes(spark):
    assert column(spark, ["00:01.5", "1:02:03,045", " 12:34.567 ", "x", "1:2.3"], tx.parse_time) == [1.5, 3723.045, 754.567, None, None]
    number = lambda f: lambda c: f(c.cast("double"))
    assert column(spark, ["3723.0456", "-1", "59.9996"], number(tx.vtt_time)) == ["01:02:03.046", "00:00:00.000", "00:00:60.000"]
    assert column(spark, ["3723.0456", "59.9996"], number(tx.srt_time)) == ["01:02:03,046", "00:01:00,000"]
    assert column(spark, ["3723.045"], number(tx.ass_time)) == ["1:02:03.04"]


def test_languages(spark):
    assert column(spark, ["en-US", "Chinese", " ZH_cn", "klingon", ""], lg.to_code) == ["en", "zh", "zh", None, None]
    assert column(spark, ["zh", "xx", None], lg.to_three_letters) == ["chi", "xx", ""]
    assert column(spark, ["English,Chinese", "'en', English；ja", ""], lg.detected_candidates) == [["English", "Chinese"], ["en", "ja"], []]
    texts = ["これはとても長いテキストです", "这是一个很长的中文句子吧", "이것은 한국어 문장", "This is a plain English sentence here", "ok", "Это русский текст здесь"]
    assert column(spark, texts, lg.dominant_script) == ["ja", "han", "ko", "latin", None, None]
    rows = spark.createDataFrame([("English", texts[1]), ("English,Chinese", texts[1]), ("Japanese", texts[1]), ("Chinese,English", texts[3]), ("English", texts[2]), ("Thai", "ok")], "d string, t string")
    assert [r[0] for r in rows.select(lg.reconcile(F.col("d"), F.col("t"))).collect()] == ["zh", "Chinese", "Japanese", "English", "ko", "Thai"]
    th = lg.policies(spark).where("lang in ('ja', 'en')").orderBy("lang").collect()
    assert [(r["clause_ms"], r["offline_ms"], r["cps"]) for r in th] == [(400, 700, 17.0), (560, 980, 7.0)]


def test_wrap():
    text = "I went to the market this morning and bought a loaf of bread"
    two = layout.wrap(text, "en", 2).split("\n")
    assert " ".join(two) == text and all(layout.width(x) <= 42 for x in two) and two[0].split()[-1] not in tx.BINDS_FORWARD_EN
    assert layout.wrap("short", "en", 2) == "short"
    cjk = "これは、とても長い字幕の行なので、二つに分けなければならない、そう思います"
    lines = layout.wrap(cjk, "ja", 3).split("\n")
    assert "".join(lines) == cjk and all(x[0] not in tx.NOT_AT_START for x in lines)
    assert layout.kinsoku(["ab「", "c"]) == ["ab", "「c"] and layout.kinsoku(["ab", "。c"]) == ["ab。", "c"]
    assert layout.fits("a" * 42, 42, 1, "en") and not layout.fits("a" * 43, 42, 2, "en") and layout.fits("字" * 18, 18, 1, "zh")


@pytest.mark.parametrize("seed", range(5))
def test_wrap_keeps_content(seed):
    r = random.Random(seed)
    for _ in range(200):
        text = " ".join("x" * r.randint(1, 12) for _ in range(r.randint(1, 25)))
        lines = layout.wrap(text, "en", r.choice([1, 2, 3]))
        assert lines.split() == text.split()
