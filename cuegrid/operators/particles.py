"""Cue edges that tear a particle from its word, in languages without spaces.

Each stretch of connected cues is a zipper: cues that stand, and cues still to come. The
edge between the two sides is looked at; two cues that become one move the zipper back, as
the edge before them has changed, and every other outcome moves it on. Merging lowers the
number of cues and moving on the number to come, so it ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import WIDE
from ..functions.layout import end_penalty, fits, solid_units, start_penalty, width
from .intervals import TRACK
from .stretches import Units, by_keys, in_stretches, spelled
from .timing import ordered

LANGS = ("zh", "yue", "ja")
TOO_BAD = 2
TINY = 1e-9


class _Edge:
    """Two neighbouring cues as one row of atoms, with what each place to cut them costs."""

    def __init__(self, left: dict, right: dict):
        self.left, self.right, self.lang = left, right, left["lang"]
        self.units = left["word_data"] + right["word_data"]
        bare = [c["text"].replace("\n", "").strip() for c in (left, right)]
        self.text = "".join(bare)
        self.atoms = solid_units(self.text)
        self.at = [0, *accumulate(map(len, self.atoms))]  # units before each atom
        self.before = len("".join(bare[0].split()))
        where = bisect_left(self.at, self.before)
        self.given = where if where < len(self.at) and self.at[where] == self.before else 0
        self.known = self.at[-1] == len(self.units) and 0 < self.given < len(self.atoms)

    def phrases(self) -> list[int] | None:
        """Units at which phrases begin, that of the second cue among them; None where they are not known."""
        left, right = self.left.get("phrases"), self.right.get("phrases")
        if left is None or right is None:
            return None
        return [*[int(p) for p in left], self.before, *[int(p) + self.before for p in right]]

    def places(self) -> list[int]:
        """Atoms that begin a phrase, and the given cut; every atom where no phrases are known."""
        known = self.phrases()
        if known is None:
            return list(range(1, len(self.atoms)))
        return [k for k in range(1, len(self.atoms)) if k == self.given or self.at[k] in known]

    def torn(self, places: list[int]) -> tuple[list[int], list[int]]:
        """What a cut at each place leaves at the end of one cue, and at the start of the next."""
        phrases, lang = self.atoms, self.lang
        if len(places) != len(self.atoms) - 1:
            edges = [0, *places, len(self.atoms)]
            phrases = ["".join(self.atoms[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return [end_penalty(p, lang) for p in phrases[:-1]], [start_penalty(p, lang) for p in phrases[1:]]

    def cheaper(self, places: list[int], here: int, ends: list[int], starts: list[int], room: int) -> list[int]:
        """The places that cost less than the ``here``-th and leave no side wider than ``room``, the least first.

        Costs are compared from the left: torn phrases, short pauses and slivers, unlike widths, later places first.
        """
        cells = [0, *accumulate([2 if len(a) == 1 and not a.isascii() else width(a) for a in self.atoms])]
        lo, start, end, at, whole = self.units.lo, self.units.start, self.units.end, self.at, cells[-1]

        def cost(k: int) -> tuple[int, int, int, int]:
            place = places[k]
            first = cells[place]
            second = whole - first
            unit = lo + at[place]
            s, e = start[unit], end[unit - 1]
            ms = 220.0 if s is None or e is None else 1000 * (s - e)
            least = first if first < second else second
            rest = (3 if ms < 40 else 2 if ms < 120 else 1 if ms < 220 else 0) + (8 if least <= 1 else 4 if least <= 2 else 0)
            return 3 * (ends[k] + starts[k]), rest, abs(first - second), -place

        most, low = ends[here] + starts[here], whole - room
        near = [k for k, place in enumerate(places) if low <= cells[place] <= room and ends[k] + starts[k] <= most and k != here]
        if not near:
            return []
        limit = cost(here)
        return [-c[3] for c in sorted(c for c in map(cost, near) if c < limit)]

    def recut(self, at: int) -> list[dict] | None:
        """The two cues for another cut; None if a side has no time."""
        k = self.at[at]
        a, b = self.units.parted(k)
        end, start = a.last_end(), b.first_start()
        if end is None or start is None:
            return None
        known = self.phrases()
        first, second = (None, None) if known is None else ([p for p in known if p < k], [p - k for p in known if p > k])
        texts = "".join(self.atoms[:at]), "".join(self.atoms[at:])
        return [self.left | {"text": texts[0], "end": end, "word_data": a, "phrases": first}, self.right | {"text": texts[1], "start": start, "word_data": b, "phrases": second}]


def mended(left: dict, right: dict, line: int, lines: int, max_s: float, connected_s: float) -> list[dict] | None:
    """The cues that two neighbours become: one, two cut elsewhere, or None if their edge stays. ``word_data`` are lists."""
    units = Units.of([*left["word_data"], *right["word_data"]])
    a, b = units.parted(len(left["word_data"]))
    found = _mended(left | {"word_data": a}, right | {"word_data": b}, line, lines, max_s, connected_s)
    listed = lambda u: [{"start": s, "end": e} for s, e in zip(u.start[u.lo : u.hi], u.end[u.lo : u.hi], strict=True)]
    return None if found is None else [c | {"word_data": listed(c["word_data"])} for c in found]


def _mended(left: dict, right: dict, line: int, lines: int, max_s: float, connected_s: float) -> list[dict] | None:
    first, second = left["text"].rstrip(), right["text"].lstrip()
    a, b = left["word_data"], right["word_data"]
    if not (first and second and len(a) and len(b)):
        return None
    if left.get("phrases") is None and end_penalty(first[-1], left["lang"]) < TOO_BAD and start_penalty(second[0], left["lang"]) < TOO_BAD:
        return None  # nothing torn, whatever else holds
    end, start = a.last_end(), b.first_start()
    end, start = left["end"] if end is None else end, right["start"] if start is None else start
    if end is None or start is None or not -1e-6 <= start - end < connected_s:
        return None
    e = _Edge(left, right)
    if not e.known:
        return None
    places = e.places()
    ends, starts = e.torn(places)
    here = places.index(e.given)
    if max(ends[here], starts[here]) < TOO_BAD:
        return None
    if right["end"] - left["start"] <= max_s + TINY and fits(e.text, line, lines, e.lang):
        return [left | {"text": e.text, "end": right["end"], "word_data": e.units, "phrases": e.phrases()}]
    for place in e.cheaper(places, here, ends, starts, line * lines * (2 if e.lang in WIDE else 1)):
        two = e.recut(place)
        if two and all(fits(c["text"], line, lines, e.lang) for c in two) and all(_spoken(c) <= max_s + TINY for c in two):
            return two
    return None  # nothing cheaper holds


def _spoken(cue: dict) -> float:
    start, end = cue["word_data"].first_start(), cue["word_data"].last_end()
    return (cue["end"] if end is None else end) - (cue["start"] if start is None else start)


def zipped(cues: list[dict], line: int, lines: int, max_s: float, connected_s: float) -> list[dict]:
    """One stretch of cues with its edges mended."""
    stand: list[dict] = []
    coming = cues[::-1]
    while coming:
        found = _mended(stand[-1], coming[-1], line, lines, max_s, connected_s) if stand else None
        if found is None:
            stand.append(coming.pop())
        elif len(found) == 1:
            stand.pop()
            coming[-1] = found[0]
        else:
            coming.pop()
            stand[-1:] = found
    return stand


def mend_particles(cues: DataFrame, line: int, lines: int, max_s: float, connected_s: float = 0.3, in_order: bool = False) -> DataFrame:
    """Cues (track_id, seq, lang, text, start, end, word_data) of Chinese, Cantonese and Japanese without edges that strand a particle.

    Two cues without a pause become one if that fits; else they are cut where least is torn.
    Each unit of ``word_data`` is one character; cues where that is not so stay. A column
    ``phrases`` with the characters at which phrases begin narrows the places to cut. Cues of other languages stay as they
    are. seq is given anew. A task holds one stretch between pauses beyond a batch. ``in_order``:
    the cues lie in the order of the track already.
    """

    def opening() -> Callable[[pa.RecordBatch], np.ndarray]:
        tracks, last = by_keys(TRACK, "lang"), []

        def opens(batch: pa.RecordBatch) -> np.ndarray:
            end = batch.column("end")
            before = pa.concat_arrays([*last, end])[:-1] if last else pa.concat_arrays([end.slice(0, 1), end])[:-1]
            last[:] = [end.slice(len(end) - 1)]
            apart = pc.greater_equal(pc.subtract(batch.column("start"), before), connected_s)
            return tracks(batch) | pc.fill_null(apart, False).to_numpy(zero_copy_only=False)

        return opens

    def some(batch: pa.RecordBatch, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        return pc.is_in(batch.column("lang").take(pa.array(starts)), pa.array(LANGS)).to_numpy(zero_copy_only=False) & (size > 1)

    def run(stretch: list[dict]) -> list[dict]:
        return zipped(stretch, line, lines, max_s, connected_s)

    rows = cues if in_order else cues.withColumn("_k", F.row_number().over(ordered()))  # kept so that the order of its window is
    return in_stretches(rows, TRACK, opening, some, run, spelled(rows)).select(cues.columns)
