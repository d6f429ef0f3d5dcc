"""Secret scanning: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass finds all keywords of a text; an expression is tried only where its
keyword starts; candidates of kinds that embed a checksum or a structure are validated.
Long hexadecimal runs have no keyword and are found by their own scan. Time grows in
proportion to the text: closing marks of key blocks are keywords of their own, and how far
a run of allowed characters reaches is remembered, so no stretch is walked once per hit.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Kinds in the order in which spans with the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "private_key", "jwt")
BASE = 3

#: keyword in lower case -> kind. Fixed formats of public services.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "-----begin": "private_key",
    "-----end": "closing",
    "eyj": "jwt",
}
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Opening and closing mark of a key block; both name the same kind of key.
OPENING = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
CLOSING = re.compile(r"-----END ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
INSIDE = re.compile(r"[A-Za-z0-9+/=:,\s-]*")
WEB = re.compile(r"[A-Za-z0-9_-]*")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[str, int, int]


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62(n: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def checksum_holds(body: str, check: str) -> bool:
    """The last six characters of such tokens are the CRC-32 of the rest in base 62."""
    return base62(zlib.crc32(body.encode())) == check


def _json_head(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


def _lower(text: str) -> str:
    """Lower case of A-Z only, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Reach:
    """Where the run of allowed characters around a place ends; every stretch is walked once."""

    def __init__(self, allowed: re.Pattern, text: str):
        self.allowed, self.text = allowed, text
        self.lo = self.hi = -1

    def end(self, at: int) -> int:
        if not self.lo <= at <= self.hi:
            self.lo, self.hi = at, self.allowed.match(self.text, at).end()
        return self.hi


class Scanner:
    """The matches of one text; each method gives (end, valid) of the match at a keyword, or None."""

    def __init__(self, text: str, closings: list[int]):
        self.text = text
        self.inside = Reach(INSIDE, text)
        self.web = [Reach(WEB, text) for _ in range(3)]  # one for each part
        self.closings: dict[str, list[tuple[int, int]]] = {}
        for at in closings:
            if m := CLOSING.match(text, at):
                self.closings.setdefault(m[1], []).append((at, m.end()))

    def assign(self, at: int) -> tuple[int, bool] | None:
        m = ASSIGN.match(self.text, at)
        return m and (m.end(), len(m[1]) >= 8)

    def access(self, at: int) -> tuple[int, bool] | None:
        m = ACCESS.match(self.text, at)
        return m and (m.end(), m.end() - at >= 16)

    def checked(self, at: int) -> tuple[int, bool] | None:
        m = CHECKED.match(self.text, at)
        return m and (m.end(), checksum_holds(m[1], m[2]))

    def private_key(self, at: int) -> tuple[int, bool] | None:
        m = OPENING.match(self.text, at)
        if not m:
            return None
        ends = self.closings.get(m[1], [])
        k = bisect_left(ends, (m.end(),))
        return (ends[k][1], True) if k < len(ends) and self.inside.end(m.end()) >= ends[k][0] else None

    def jwt(self, at: int) -> tuple[int, bool] | None:
        text, begin, end = self.text, at, at - 1
        for k, head in enumerate(("eyJ", "eyJ", "")):
            if k and text[end : end + 1] != ".":
                return None
            begin = end + 1
            if not text.startswith(head, begin):
                return None
            end = self.web[k].end(begin)
            if end - begin <= len(head):
                return None
            if not k:
                first = end
        return end, _json_head(text[at:first])


def scan(text: str) -> list[Span]:
    """All spans (kind, start, end), in code points, by start and then kind.

    Per kind the matches are leftmost and do not overlap; a match that fails its check is
    dropped but still ends where it ends.
    """
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(_lower(text)))
    scanner = Scanner(text, [at for at, kind in hits if kind == "closing"])
    match = {"assign": scanner.assign, "access": scanner.access, "github": scanner.checked, "npm": scanner.checked, "private_key": scanner.private_key, "jwt": scanner.jwt}
    free = dict.fromkeys(match, 0)
    for start, kind in hits:
        if kind == "closing" or start < free[kind]:
            continue
        if m := match[kind](start):
            free[kind] = m[0]
            if m[1]:
                found.append((kind, start, m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[Span], mask: str) -> str:
    """The text with every span, overlapping ones joined, replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, keep: list[str] | None = None, mask: str | None = None) -> DataFrame:
    """``keep`` columns of every row and ``_spans``: array<struct<kind,start,end>>; with ``mask``
    also ``_clean``, the text with the spans masked.

    Null or empty text: no spans; a null text stays null. Very long text: scanned whole.
    Repeated rows, null ids: each row by itself. Empty table: no rows. Other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    given = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    fields = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    fields.append("_spans array<struct<kind:string,start:long,end:long>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    if mask is not None:
        fields.append("_clean string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            texts = part.column(len(keep)).to_pylist()
            spans = [scan(t or "") for t in texts]
            listed = [[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in spans]
            columns = [*part.columns[: len(keep)], pa.array(listed, kind)]
            names = [*part.schema.names[: len(keep)], "_spans"]
            if mask is not None:
                columns.append(pa.array([redact(t, s, mask) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
                names.append("_clean")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = given.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "_spans", *["_clean"] * (mask is not None))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
