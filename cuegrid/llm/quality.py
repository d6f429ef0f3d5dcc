"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each document: characters per token, the
share of byte-fallback tokens, and the entropy of its tokens. Documents outside the bands
of their script are rejected, besides those that fail the plain rules (too few words, or
too many words in repeated windows). The bands of a script are wide; ``corpus_bands``
derives narrow ones from all documents of one language, script and length, and
``within_corpus`` holds the documents to them as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .textscan import buffers, grams, mix, word_hashes, words

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
CHUNK = 2 << 20


class Band(NamedTuple):
    """Limits of a script; a document outside any of them is rejected."""

    chars_per_token: tuple[float, float]
    byte_share: float  # at most
    entropy_share: float  # at least; entropy / log2(tokens), with no more than FULL_TOKENS


#: Scripts told apart by the lead bytes of their UTF-8 letters, and their bands. A text whose
#: script has no band of its own is held to that of ``other``.
SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul", "other")
BANDS = {
    "latin": Band((1.5, 7.0), 0.08, 0.3),
    "greek": Band((0.8, 7.0), 0.6, 0.3),
    "cyrillic": Band((1.0, 7.0), 0.3, 0.3),
    "semitic": Band((0.5, 7.0), 0.8, 0.25),
    "indic": Band((0.25, 7.0), 0.6, 0.2),
    "cjk": Band((0.3, 7.0), 0.6, 0.2),
    "hangul": Band((0.3, 7.0), 0.6, 0.2),
    "other": Band((0.2, 8.0), 0.6, 0.4),
}
#: With fewer tokens than this only the plain rules hold; a text that passes them has as many.
LEAST_TOKENS = 20
#: The entropy of a text stops growing with its length; longer texts are held to this many tokens.
FULL_TOKENS = 1024
#: Half the width of a corpus band, in robust standard deviations, and the least of these for each figure.
WIDTH = 4.0
LEAST_SPREAD = {"fertility": 0.02, "share": 0.02, "spread": 0.01}
#: A group of fewer documents has no bands of its own: those of its language and script over all lengths hold for fertility and byte fallback, if they have as many.
LEAST_GROUP = 100


def _script_table() -> np.ndarray:
    kind = np.full(256, len(SCRIPTS), np.uint8)  # not a letter's lead byte
    put = lambda name, lead: kind.__setitem__(list(lead), SCRIPTS.index(name))
    put("latin", [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)])
    put("greek", [0xCD, 0xCE, 0xCF])
    put("cyrillic", [0xD0, 0xD1, 0xD2, 0xD3])
    put("semitic", range(0xD6, 0xDF))
    put("indic", [0xE0])
    put("cjk", range(0xE3, 0xEA))
    put("hangul", range(0xEA, 0xEE))
    put("other", [0xCB, 0xCC, 0xD4, 0xD5, 0xDF, 0xE1, 0xF0])
    return kind


SCRIPT_OF = _script_table()
_processors: dict[str, tuple] = {}


def _processor(path: str):
    if path not in _processors:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = np.array([p.is_byte(i) for i in range(p.get_piece_size())], bool)
        _processors[path] = (p, byte)
    return _processors[path]


def _spread(flat: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (lengths ``lens``) picked in order, concatenated, and their lengths."""
    own = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
    n = lens[pick]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(own[pick] - (ends - n), n)
    return flat[at], n


def repeat_words(h: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """For each row the number of its words inside ``width``-word windows found twice or more in it."""
    rows = len(first) - 1
    if len(h) < width:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    inside = row[: len(h) - width + 1] == row[width - 1 :]
    at = np.flatnonzero(inside)
    key = mix(grams(h, width)[at] + mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def token_figures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray, path: str):
    """(tokens, byte-fallback tokens, entropy in bits) of each row; every distinct word is encoded once."""
    rows = len(first) - 1
    if not len(h):
        z = np.zeros(rows)
        return z.astype(np.int64), z.astype(np.int64), z
    processor, is_byte = _processor(path)
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = processor.encode([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in sample], num_threads=1)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((i for p in pieces for i in p), np.int64, int(lens.sum()))
    tokens, n = _spread(flat, lens, which)
    row = np.repeat(np.repeat(np.arange(rows), np.diff(first)), n)
    count = np.bincount(row, minlength=rows)
    fallback = np.bincount(row, weights=is_byte[tokens], minlength=rows).astype(np.int64)
    key, times = np.unique(row * len(is_byte) + tokens, return_counts=True)
    of = key // len(is_byte)
    p = times / count[of]
    return count, fallback, np.bincount(of, weights=-p * np.log2(p), minlength=rows)


def assess(docs: DataFrame, vocabulary: str, bands: dict[str, Band] = BANDS, keep: list[str] | None = None) -> DataFrame:
    """Figures and verdict for every row: ``keep`` columns, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_tokens, byte_tokens, entropy, script, kept.

    Null or empty text: no words, hence base_failed. Very long text: handled whole, in
    vectors of its words. Repeated rows, null ids: each row is judged by itself. Empty
    table: no rows. Columns beyond ``keep`` are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    # a text that is kept anyway goes to the workers once
    source = f"_k{keep.index('text')}" if "text" in keep else "_text"
    given = docs.select(*named, *([F.col("text").alias("_text")] if source == "_text" else []))
    head = ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    tail = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, byte_tokens long, entropy double, script string, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, source, CHUNK):
            text = part.column(part.schema.get_field_index(source))
            data, bounds = buffers(text)
            starts, ends, first = words(data, bounds)
            h = word_hashes(data, starts, ends)
            n_words = np.diff(first)
            chars, symbols, lines, script = [], [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                raw = data[lo:hi]
                b = raw.tobytes()
                chars.append(len(b.translate(None, SPACES + CONTINUATION)))
                symbols.append(len(b) - len(b.translate(None, SYMBOLS)))
                lines.append(duplicate_lines(b))
                votes = np.bincount(SCRIPT_OF[raw], minlength=len(SCRIPTS) + 1)[:-1]
                script.append(SCRIPTS[int(votes.argmax())] if votes.any() else "other")
            chars = np.array(chars, np.int64)
            repeats = repeat_words(h, first)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            count, fallback, entropy = token_figures(data, starts, ends, first, h, vocabulary)
            limit = [bands.get(s, bands["other"]) for s in script]
            some = np.maximum(count, 1)
            fertility, share = chars / some, fallback / some
            spread = entropy / np.log2(np.clip(count, 2, FULL_TOKENS))
            low = np.array([b.chars_per_token[0] for b in limit])
            high = np.array([b.chars_per_token[1] for b in limit])
            odd = (fertility < low) | (fertility > high) | (share > np.array([b.byte_share for b in limit])) | (spread < np.array([b.entropy_share for b in limit]))
            kept = ~failed & ~(odd & (count >= LEAST_TOKENS))
            columns = [*[part.column(i) for i in range(len(keep))], *map(pa.array, (n_words.astype(np.int64), chars, np.array(symbols, np.int64), np.array(lines, np.int64), repeats.astype(np.int64), failed, count.astype(np.int64), fallback, entropy)), pa.array(script, pa.string()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, [*[f"_k{i}" for i in range(len(keep))], *[c.split()[0] for c in tail.split(", ")]])

    out = given.mapInArrow(run, f"{head}, {tail}" if keep else tail)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[c.split()[0] for c in tail.split(", ")])


def _figures() -> dict[str, Column]:
    count = F.greatest(F.col("n_tokens"), F.lit(1))
    full = F.least(F.greatest(F.col("n_tokens"), F.lit(2)), F.lit(FULL_TOKENS))
    return {"fertility": F.col("word_chars") / count, "share": F.col("byte_tokens") / count, "spread": F.col("entropy") / F.log2(full)}


def _group(judged: DataFrame) -> dict[str, Column]:
    """Language (where there is such a column), script, and the power of two of the length, up to FULL_TOKENS."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in judged.columns else F.lit("")
    length = F.floor(F.log2(F.least(F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(FULL_TOKENS)))).cast("int")
    return {"_lang": lang, "_script": F.col("script"), "_length": length}


#: The length of a group that holds documents of all lengths.
ANY_LENGTH = -1


def corpus_bands(judged: DataFrame) -> DataFrame:
    """Bands (_lang, _script, _length, and a middle and a reach for each figure) from every document that passes the plain rules.

    ``judged`` is what ``assess`` returns. Besides those by length there are bands of each
    language and script over all lengths, for documents whose length has too few; they limit
    what does not depend on the length, fertility and byte fallback. Quartiles
    are exact to the third decimal and merge across tasks, so the bands do not depend on how
    rows are dealt.
    """
    rows = judged.where("not base_failed").select(*[c.alias(k) for k, c in _group(judged).items()], *[F.round(c, 3).alias(k) for k, c in _figures().items()])
    rows = rows.withColumn("_length", F.explode(F.array("_length", F.lit(ANY_LENGTH))))
    quarters = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    groups = rows.groupBy("_lang", "_script", "_length").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(k, quarters).alias(k) for k in LEAST_SPREAD])
    # the quartiles of a normal distribution lie 1.349 standard deviations apart
    reach = {f"_{k}_reach": WIDTH * F.greatest((F.col(k)[2] - F.col(k)[0]) / 1.349, F.lit(least)) for k, least in LEAST_SPREAD.items()}
    middle = {f"_{k}_middle": F.col(k)[1] for k in LEAST_SPREAD}
    return groups.where(F.col("_n") >= LEAST_GROUP).select("_lang", "_script", "_length", *[c.alias(k) for k, c in (middle | reach).items()])


def within_corpus(judged: DataFrame, bands: DataFrame) -> DataFrame:
    """``judged`` with ``kept`` also false outside the corpus bands: fertility on either side, much byte fallback, little entropy."""
    limits = [c for c in bands.columns if c not in ("_lang", "_script", "_length")]
    # bounded: a row for each group of LEAST_GROUP documents or more
    own = F.broadcast(bands)
    whole = F.broadcast(bands.where(F.col("_length") == ANY_LENGTH).drop("_length").select("_lang", "_script", *[F.col(c).alias(f"{c}_any") for c in limits]))
    rows = judged.withColumns(_group(judged)).join(own, ["_lang", "_script", "_length"], "left").join(whole, ["_lang", "_script"], "left")
    limit = {c: F.col(c) if c.startswith("_spread") else F.coalesce(c, f"{c}_any") for c in limits}
    off = {k: c - limit[f"_{k}_middle"] for k, c in _figures().items()}
    reach = {k: limit[f"_{k}_reach"] for k in off}
    odd = [F.abs(off["fertility"]) > reach["fertility"], off["share"] > reach["share"], -off["spread"] > reach["spread"]]
    odd = reduce(or_, [F.coalesce(o, F.lit(False)) for o in odd])
    return rows.withColumn("kept", F.col("kept") & ~odd).select(judged.columns)
