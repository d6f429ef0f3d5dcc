"""Text measures and clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that subtitles drop, and unit signs that stick to a number.
PAUSE_COMMAS = "，、﹐﹑"
DROPPED = ";!?:。；！？：﹒﹔﹕﹖﹗" + PAUSE_COMMAS
UNIT_SIGNS = "%％‰°℃℉"
EXTRA_DROPPED = "「」『』｢｣〝〟“”‘’（）()【】〔〕《》〈〉［］｛｝…⋯—–―"

# Words after which an English line does not end.
BINDS_FORWARD_EN = (
    "a an the this that these those my your his her its our their some any no every each "
    "of to in on at by for with from into onto over under about as than "
    "and or but nor so yet because if while when "
    "is are was were be been am will would can could shall should may might must do does did have has had"
).split()
# Particles and words that bind to what follows (ends) or to what precedes (starts).
KANA_STRONG, KANA_MILD = "のをにへ", "とまでより"
ZH_END_STRONG = "的 地 得 把 被 比 跟 和 与 或 及 而".split()
ZH_END_MILD = "在 对 从 向 往 给 让 由 很 太 更 最".split()
ZH_START = "的 地 得 了 着 过 吗 呢 吧 啊 呀 嘛 啦 呐".split()
JA_START_STRONG, JA_START_MILD = "の を に へ".split(), "で が と".split()
NOT_AT_START = "、。，．・：；？！）｝〕〉》」』】〙〗〟’”»ァィゥェォッャュョヮぁぃぅぇぉっゃゅょゎーゝゞ々‐゠–〜%"
NOT_AT_END = "（｛〔〈《「『【〘〖〝‘“«([{"


# The forms of a stutter, of a sentence's end, of a break inside of a word and of a time code.
STUTTER = r"(?i)(?<![\p{L}\p{M}\p{N}_])([A-Za-z]+)(\s+)(\1)(?![\p{L}\p{M}\p{N}_])"
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s*"
INNER_BREAK = r"(?<=.)(—|–|--+|…|\.\.\.)(?=.)"
TIME_CODE = r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def ascii_only(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def visual_width(s: Column) -> Column:
    """Columns on screen: ASCII and white space one, everything else two."""
    wide = F.regexp_replace(s, r"(?U)[\x00-\x7F\s]++", "")
    return F.length(s) + F.when(ascii_only(s), 0).otherwise(F.length(wide))


def reading_chars(s: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(s, r"(?U)\s++", ""))


def content_mass(s: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]++", ""))


def visual_length(s: Column, spaced: Column) -> Column:
    """Characters other than white space, commas at the end left out."""
    bare = F.trim(s)
    bare = F.when(spaced, F.regexp_replace(bare, ",+$", "")).otherwise(F.regexp_replace(bare, f"[,{PAUSE_COMMAS}]+$", ""))
    return reading_chars(bare)


def spaced_tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def unspaced_tokens(s: Column) -> Column:
    """Single characters, ASCII runs (also across spaces) whole, a unit sign joined to the number before it.

    The repeats are possessive: Java's matcher then loops where it would recurse for every word.
    """
    run, blank = "[A-Za-z0-9._-]++", r"(?U:\s)"
    raw = F.regexp_extract_all(s, F.lit(rf"({run}(?:{blank}++{run})*+(?:(?<=[0-9]){blank}*+[{UNIT_SIGNS}])?+|(?U:\S))"), F.lit(1))
    return F.transform(raw, lambda t: F.regexp_replace(t, rf"(?<=[0-9]){blank}++(?=[{UNIT_SIGNS}]$)", ""))


def tokens(s: Column, spaced: Column) -> Column:
    return F.when(spaced, spaced_tokens(s)).otherwise(unspaced_tokens(s))


def join_tokens(words: Column, spaced: Column) -> Column:
    return F.when(spaced, F.array_join(words, " ")).otherwise(F.array_join(words, ""))


def strip_punctuation(s: Column) -> Column:
    """Punctuation becomes space, a point or comma before a digit stays; white space is tidied."""
    s = F.regexp_replace(s, rf"[.,](?![0-9])|[{DROPPED}]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_for_translation(s: Column) -> Column:
    """As ``strip_punctuation``, quotes, brackets, ellipses and dashes going first."""
    return strip_punctuation(F.translate(s, EXTRA_DROPPED, " " * len(EXTRA_DROPPED)))


def merge_stutters(s: Column, rounds: int = 6) -> Column:
    """Repeated ASCII words joined by hyphens, ``I I I`` to ``I-I-I``; up to 2**rounds repeats."""
    step = lambda c: F.regexp_replace(c, STUTTER, "$1-$3")
    # few texts have any: the others are looked through once
    return once(s, lambda t: F.when(t.rlike(STUTTER), reduce(lambda c, _: step(c), range(rounds), t)).otherwise(t))


def strip_trailing_punctuation(s: Column) -> Column:
    """Without what follows the last letter or digit; unchanged if there is none."""
    bare = F.regexp_replace(s, r"[^\p{L}\p{N}]+$", "")
    return F.when(bare == "", s).otherwise(bare)


def line_end_penalty(s: Column, lang: Column) -> Column:
    """0 fine, 1 mild, 2 bad: how much ending a line on this word leaves hanging."""
    bare = F.rtrim(s)
    last = F.right(bare, F.lit(1))
    word = F.lower(F.regexp_replace(bare, "^[.,!?;:'\"”’]+|[.,!?;:'\"”’]+$", ""))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", 0)
        .when(F.lit(KANA_STRONG).contains(last), 2)
        .when(F.lit(KANA_MILD).contains(last), 1)
        .when((lang == "en") & word.isin(BINDS_FORWARD_EN), 2)
        .when(lang.isin("zh", "yue") & bare.isin(ZH_END_STRONG), 2)
        .when(lang.isin("zh", "yue") & bare.isin(ZH_END_MILD), 1)
        .otherwise(0)
    )


def line_start_penalty(s: Column, lang: Column) -> Column:
    """0 fine, 1 mild, 2 bad: how much beginning a cue with this phrase tears off."""
    bare = F.ltrim(s)
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", 0)
        .when(F.lit(NOT_AT_START).contains(F.left(bare, F.lit(1))), 2)
        .when(lang.isin("zh", "yue"), F.when(bare.isin(ZH_START), 2).otherwise(0))
        .when((lang == "ja") & bare.isin(JA_START_STRONG), 2)
        .when((lang == "ja") & bare.isin(JA_START_MILD), 1)
        .otherwise(0)
    )


def legal_break(words: Column, lang: Column, target: Column) -> Column:
    """Break index nearest to ``target`` whose left word may end a line, the left one of two; else ``target``."""

    def found(x: Column) -> Column:
        words, n, aim = x["words"], F.size(x["words"]), F.greatest(F.lit(1), F.least(x["target"], F.size(x["words"])))
        fine = lambda w, i: (i + 1 < n) & ~F.lower(F.btrim(w, F.lit(".,!?;:"))).isin(BINDS_FORWARD_EN)
        best = F.array_min(F.transform(words, lambda w, i: F.when(fine(w, i), F.struct(F.abs(i + 1 - aim).alias("d"), (i + 1).alias("i")))))["i"]
        return F.when((x["lang"] != "en") | (n <= 1), aim).otherwise(F.coalesce(best, aim))

    return once(F.struct(words.alias("words"), lang.alias("lang"), target.alias("target")), found)


def lyric_display(s: Column, lyric: Column) -> Column:
    return F.when(F.coalesce(lyric, F.lit(False)), F.concat(F.lit("♪ "), s, F.lit(" ♪"))).otherwise(s)


def is_lyric(s: Column) -> Column:
    return (F.length(s) > 2) & s.startswith("♪") & s.endswith("♪")


def lyric_text(s: Column) -> Column:
    return F.when(is_lyric(s), F.trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def is_dash_cue(s: Column) -> Column:
    """Exactly two lines, each a hyphen and something: two speakers."""
    lines = F.split(s, "\n")
    return (F.size(lines) == 2) & F.forall(lines, lambda x: x.rlike(r"^-(?U:\s)*(?U:\S)"))


def one_line(s: Column) -> Column:
    """Without dashes in front, white space flattened."""
    bare = F.regexp_replace(s, r"^(?U:\s)*[-–—]+(?U:\s)*", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def dash_parts(s: Column) -> Column:
    return F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^(?U:\s)*[-–—]+(?U:\s)*", "")))


def split_at_breaks(token: Column) -> Column:
    """A token cut after inner dashes and ellipses that have text on both sides."""
    marked = F.regexp_replace(token, INNER_BREAK, "$1\u0001")
    return F.split(marked, "\u0001")


def sentences(s: Column) -> Column:
    """Cut after final punctuation; white space after it goes."""
    return F.filter(F.split(s, SENTENCE_END), lambda x: F.trim(x) != "")


def letters_of(s: Column) -> Column:
    """The letters and digits one by one."""
    return F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]"), F.lit(0))


def parse_time(s: Column) -> Column:
    """Seconds from ``[HH:]MM:SS.mmm`` (or a comma); null if it is not one."""
    t = F.trim(s)
    g = lambda i: F.regexp_extract(t, TIME_CODE, i)
    whole = F.coalesce(F.nullif(g(1), F.lit("")).cast("long"), F.lit(0)) * 3600 + g(2).cast("long") * 60 + g(3).cast("long")
    return F.when(t.rlike(TIME_CODE), whole + F.rpad(g(4), 3, "0").cast("int") / 1000.0)


def vtt_time(t: Column) -> Column:
    """``HH:MM:SS.mmm``; the seconds are rounded by themselves and may read 60.000."""
    s = F.greatest(t, F.lit(0.0))
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def srt_time(t: Column) -> Column:
    ms = F.bround(F.greatest(t, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(t: Column) -> Column:
    cs = F.bround(F.greatest(t, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)
