"""Languages: names and codes, writing policy, thresholds, script evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_only, once

# Languages by code, their names and three-letter codes.
NAMES = {"yue": "cantonese", "zh": "chinese", "en": "english", "fr": "french", "de": "german", "it": "italian", "ja": "japanese", "ko": "korean", "pt": "portuguese", "ru": "russian", "es": "spanish"}
THREE_LETTERS = {
    "en": "eng", "zh": "chi", "ja": "jpn", "ko": "kor", "yue": "chi", "es": "spa", "fr": "fra", "de": "deu", "it": "ita", "pt": "por",
    "ru": "rus", "ar": "ara", "hi": "hin", "nl": "nld", "tr": "tur", "vi": "vie", "th": "tha", "id": "ind", "uk": "ukr", "pl": "pol",
}
# Three sets that differ on purpose: layout, alignment and calibration each have their own.
UNSPACED_LAYOUT = ("zh", "yue", "ja", "th", "lo", "my")
UNSPACED_ALIGN = ("zh", "ja", "yue")
UNSPACED_METRICS = ("zh", "ja", "th", "lo", "my")
WIDE = ("zh", "yue", "ja", "ko")
ONE_LINE = ("zh", "yue", "ja")
LATIN = ("en", "fr", "de", "it", "pt", "es")

# Timing thresholds.
CLAUSE_MS, SKIP_MS, OFFLINE_MS, JA_FACTOR = 400, 1000, 700, 1.4
MIN_CUE_S, MAX_CUE_S, GLUE_GAP_S, LAG_OUT_S, SHOT_SNAP_S = 0.5, 7.0, 0.3, 0.25, 0.458
CPS = {"ja": 7.0, "zh": 9.0, "yue": 9.0, "ko": 9.0}
CPS_OTHER = 17.0
COMMA = {"ja": "、", "zh": "，"}


# What parts a detector's labels, what counts as a Latin word, and how much of a text a script must be.
LABEL_SEPARATORS = "[,，;；|/]+"
LATIN_WORD = r"[A-Za-z]++(?:['’-][A-Za-z]++)*+"
HANGUL_LEAST, KANA_LEAST, CJK_LEAST, HAN_LEAST, LATIN_LEAST, LATIN_WORDS = 4, 2, 4, 4, 12, 4
CJK_SHARE, LATIN_SHARE, KANA_PER_CJK = (3, 5), (4, 5), 6


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def canonical(raw: Column) -> Column:
    """Lower case without region or script subtags; null if blank."""
    head = F.split(F.regexp_replace(F.lower(F.trim(raw)), "_", "-"), "-")[0]
    return F.nullif(head, F.lit(""))


def to_code(raw: Column) -> Column:
    """Two- or three-letter code of a supported language given by code or name; else null."""
    key = canonical(raw)
    return F.when(key.isin(list(NAMES)), key).otherwise(_lookup({n: c for c, n in NAMES.items()}, key))


def is_supported(raw: Column) -> Column:
    return to_code(raw).isNotNull()


def to_name(raw: Column) -> Column:
    return _lookup(NAMES, to_code(raw))


def display_name(raw: Column) -> Column:
    return F.initcap(to_name(raw))


def to_three_letters(code: Column) -> Column:
    low = F.lower(F.coalesce(code, F.lit("")))
    return F.coalesce(_lookup(THREE_LETTERS, low), low)


def spaced(lang: Column) -> Column:
    return ~F.coalesce(lang.isin(*UNSPACED_LAYOUT), F.lit(False))


def max_lines(lang: Column) -> Column:
    return F.when(lang.isin(*ONE_LINE), 1).otherwise(2)


def max_line_length(lang: Column) -> Column:
    return F.when(lang.isin(*ONE_LINE), 18).when(lang.isin(*WIDE), 12).otherwise(42)


def line_budget(lang: Column) -> Column:
    """Columns of a line on screen."""
    return max_line_length(lang) * F.when(lang.isin(*WIDE), 2).otherwise(1)


def comma(lang: Column) -> Column:
    return F.coalesce(_lookup(COMMA, lang), F.lit(","))


def thresholds(lang: Column) -> dict[str, Column]:
    """Timing thresholds of a language, as columns."""
    ja = lang == "ja"
    scaled = lambda ms: F.when(ja, round(ms * JA_FACTOR)).otherwise(ms)
    return {
        "clause_ms": scaled(CLAUSE_MS),
        "skip_ms": F.lit(SKIP_MS),
        "offline_ms": scaled(OFFLINE_MS),
        "min_cue_s": F.lit(min(MIN_CUE_S, 5.0 / 6.0)),
        "max_cue_s": F.lit(MAX_CUE_S),
        "glue_gap_s": F.lit(GLUE_GAP_S),
        "cps": F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CPS.items() for x in kv]), lang), F.lit(CPS_OTHER)),
        "lag_out_s": F.lit(LAG_OUT_S),
        "shot_snap_s": F.lit(SHOT_SNAP_S),
    }


def policies(spark: SparkSession) -> DataFrame:
    """One row per language: writing policy and thresholds."""
    lang = F.col("lang")
    rows = spark.createDataFrame([(c,) for c in sorted({*THREE_LETTERS, *UNSPACED_LAYOUT})], "lang string")
    return rows.select("lang", to_three_letters(lang).alias("three"), spaced(lang).alias("spaced"), max_lines(lang).alias("max_lines"), max_line_length(lang).alias("max_line_length"), *[c.alias(n) for n, c in thresholds(lang).items()])


def detected_candidates(raw: Column) -> Column:
    """Labels of a detector's answer in order, without repeats of the same language."""
    parts = F.transform(F.split(raw, LABEL_SEPARATORS), lambda p: F.trim(F.regexp_replace(F.trim(p), "^[\"']+|[\"']+$", "")))
    parts = F.filter(parts, lambda p: p != "")
    key = lambda p: F.coalesce(to_code(p), F.lower(p))
    first = F.filter(F.transform(parts, lambda p, i: F.when(F.array_position(F.transform(parts, key), key(p)) == i + 1, p)), lambda p: p.isNotNull())
    return F.coalesce(first, F.array().cast("array<string>"))


def script_counts(s: Column) -> dict[str, Column]:
    """Letters per script family."""
    # The blocks of each script.
    n = lambda pattern: F.regexp_count(s, F.lit(pattern))
    han = n(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]")
    kana = n(r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}]")
    hangul = n(r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}]")
    latin = n(r"[\p{IsLatin}&&\p{L}]")
    other = n(r"[\p{L}&&[^\p{IsLatin}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}]]")
    # other characters are not looked for in ASCII texts
    some = lambda c: F.when(ascii_only(s), 0).otherwise(c)
    ascii_letters = F.length(F.regexp_replace(s, "[^A-Za-z]++", ""))
    return {"han": some(han), "kana": some(kana), "hangul": some(hangul), "latin": F.when(ascii_only(s), ascii_letters).otherwise(latin), "other": some(other)}


def dominant_script(s: Column) -> Column:
    """``ko``, ``ja``, ``han`` or ``latin`` on strong evidence, else null."""
    most = lambda n, share, total: n * share[1] >= total * share[0]

    def strongest(c: Column) -> Column:
        total = c["han"] + c["kana"] + c["hangul"] + c["latin"] + c["other"]
        cjk = c["han"] + c["kana"]
        kana_rich = c["kana"] * KANA_PER_CJK >= cjk
        return (
            F.when(total == 0, None)
            .when((c["hangul"] >= HANGUL_LEAST) & most(c["hangul"], CJK_SHARE, total), "ko")
            .when((c["kana"] >= KANA_LEAST) & (cjk >= CJK_LEAST) & most(cjk, CJK_SHARE, total) & kana_rich, "ja")
            .when((c["han"] >= HAN_LEAST) & most(c["han"], CJK_SHARE, total) & ~kana_rich, "han")
            .when((c["latin"] >= LATIN_LEAST) & (c["words"] >= LATIN_WORDS) & most(c["latin"], LATIN_SHARE, total), "latin")
        )

    words = F.regexp_count(s, F.lit(LATIN_WORD))
    return once(F.struct(*[n.alias(k) for k, n in script_counts(s).items()], words.alias("words")), strongest)


def reconcile(detected: Column, s: Column, override: Column | None = None) -> Column:
    """The language of a transcript from the detector's labels and the script of its text."""
    pick = lambda labels, ok: F.element_at(F.filter(labels, ok), 1)
    first = lambda labels, ok: F.when(F.exists(labels, ok), pick(labels, ok))

    def chosen(x: Column) -> Column:
        labels, script = x["labels"], x["script"]
        return (
            F.when(script == "han", F.coalesce(first(labels, lambda p: to_code(p).isin("zh", "yue", "ja")), F.lit("zh")))
            .when(script.isin("ja", "ko"), F.coalesce(first(labels, lambda p: to_code(p) == script), script))
            .when(script == "latin", F.coalesce(first(labels, lambda p: to_code(p).isin(*LATIN)), F.get(labels, F.lit(0))))
            .otherwise(F.get(labels, F.lit(0)))
        )

    out = once(F.struct(detected_candidates(detected).alias("labels"), dominant_script(s).alias("script")), chosen)
    return out if override is None else F.coalesce(F.nullif(F.trim(override), F.lit("")), out)
