"""Python passes over short stretches of a track, many of them in one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a step of ``reduced`` does with the top of the stack: it goes into the cue ahead, or into the one below.
AHEAD, BACK = "ahead", "back"
#: (cue below, top, cue ahead) to (AHEAD or BACK, the cue that comes of it), or None to leave the top as it is.
Step = Callable[[dict | None, dict, dict | None], tuple[str, dict] | None]


def reduced(cues: list[dict], step: Step) -> list[dict]:
    """Shift and reduce: each cue is asked once, when the cue ahead of it is known, what becomes of it.

    A cue that takes up the top comes next and is asked in its turn; the cue below, which
    has been asked, is not asked again. Every step shortens what is left, so this ends.
    """
    stack: list[dict] = []
    asked = True
    for ahead in [*cues, None]:
        if not asked:
            found = step(stack[-2] if len(stack) > 1 else None, stack[-1], ahead)
            if found is not None and found[0] == AHEAD:
                stack.pop()
                ahead = found[1]
            elif found is not None:
                stack[-2:] = [found[1]]
        if ahead is not None:
            stack.append(ahead)
        asked = False
    return stack


#: Rows after which a batch of results is handed on.
ROWS = 10_000


def each_stretch(rows: DataFrame, keys: list[str], change: Callable[[list[dict]], list[dict]], schema: str, order: str = "seq") -> DataFrame:
    """``change`` applied to the rows of each key in order; a task holds one stretch and some thousand results."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        out: list[dict] = []
        key = None
        for frame in frames:
            for r in frame.to_dict("records"):
                now = tuple(None if pd.isna(r[k]) else r[k] for k in keys)
                if held and now != key:
                    out += change(held)
                    held = []
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                key = now
                held.append(r)
        out += change(held) if held else []
        yield pd.DataFrame(out, columns=names)

    names = [part.split()[0].strip("`") for part in _fields(schema)]
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def by_keys(*keys: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Tells for each batch in turn which rows differ from the one before in any key; the very first row does."""
    last: list[pa.Array] = []

    def opens(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(k) for k in keys]
        at = changes(*[pa.concat_arrays([a, b]) for a, b in zip(last, columns, strict=True)])[1:] - 1 if last else changes(*columns)
        last[:] = [c.slice(batch.num_rows - 1) for c in columns]
        new = np.zeros(batch.num_rows, bool)
        new[at] = True
        return new

    return opens


def whole_runs(batches: Iterator[pa.RecordBatch], opens: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole stretches and the places where these begin; ``opens`` tells for each batch in turn which rows begin one."""
    held: list[pa.RecordBatch] = []
    marks: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = opens(batch)
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if new[cut] and (held or cut):
            yield pa.concat_batches([*held, batch.slice(0, cut)]), np.flatnonzero(np.concatenate([*marks, new[:cut]]))
            held, marks = [], []
        else:
            cut = 0
        held.append(batch.slice(cut))
        marks.append(new[cut:])
    if held:
        yield pa.concat_batches(held), np.flatnonzero(np.concatenate(marks))


def listed(column: pa.Array) -> list:
    """The values of a column; numbers are not taken one by one."""
    kind = column.type
    if column.null_count == len(column) or not (pa.types.is_floating(kind) or pa.types.is_integer(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    out = pc.fill_null(column, 0).to_numpy().tolist()
    for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[k] = None
    return out


def records(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch; a missing double is no number."""
    names = batch.schema.names
    columns = [listed(pc.fill_null(c, np.nan) if pa.types.is_floating(c.type) else c) for c in batch.columns]
    return [dict(zip(names, row)) for row in zip(*columns)]  # noqa: B905


def numbering(key: str) -> Callable[[pa.RecordBatch, np.ndarray], np.ndarray]:
    """Counts for each batch in turn the marked rows up to and including each one, from 0 for the first of each key."""
    opens, held = by_keys(key), 0

    def number(batch: pa.RecordBatch, marked: np.ndarray) -> np.ndarray:
        nonlocal held
        upto = np.cumsum(marked)
        first = np.flatnonzero(opens(batch))
        base = np.repeat(np.append(-held, upto[first] - marked[first]), np.diff([0, *first, batch.num_rows]))
        count = upto - base
        held = int(count[-1])
        return count - 1

    return number


class Units:
    """Timed units of a cue, or of neighbours: a range of those of all cues passed together, which stay where they are."""

    __slots__ = ("end", "hi", "lo", "start")

    def __init__(self, start: list, end: list, lo: int, hi: int):
        self.start, self.end, self.lo, self.hi = start, end, lo, hi

    @staticmethod
    def of(given: list[dict]) -> Units:
        return Units([u["start"] for u in given], [u["end"] for u in given], 0, len(given))

    def __len__(self) -> int:
        return self.hi - self.lo

    def __add__(self, after: Units) -> Units:
        """With the units of the next cue."""
        if self.start is not after.start or self.hi != after.lo:
            raise ValueError("units that are not neighbours")
        return Units(self.start, self.end, self.lo, after.hi)

    def parted(self, k: int) -> tuple[Units, Units]:
        return Units(self.start, self.end, self.lo, self.lo + k), Units(self.start, self.end, self.lo + k, self.hi)

    def first_start(self) -> float | None:
        for k in range(self.lo, self.hi):
            if self.start[k] is not None:
                return self.start[k]
        return None

    def last_end(self) -> float | None:
        for k in range(self.hi - 1, self.lo - 1, -1):
            if self.end[k] is not None:
                return self.end[k]
        return None


def with_units(batch: pa.RecordBatch, column: str = "word_data") -> tuple[list[dict], pa.Array]:
    """The rows of a batch with ``Units`` for lists of (start, end), and the units of all of them; a missing list is empty."""
    rows = records(batch.drop_columns([column]))
    lists = batch.column(column)
    flat = lists.flatten()
    start, end = (listed(flat.flatten()[flat.type.get_field_index(side)]) for side in ("start", "end"))
    at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())).tolist()
    for r, lo, hi in zip(rows, at, at[1:], strict=False):
        r[column] = Units(start, end, lo, hi)
    return rows, flat


def in_stretches(rows: DataFrame, key: str, opening: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], some: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], change: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``change`` applied to stretches of rows that lie in order (key, seq); they pass once and none is moved. seq is given anew.

    A cue's ``word_data`` are ``Units``; ``change`` keeps all of them, in order.
    ``opening`` gives what tells where stretches begin; ``some`` gets a batch of whole
    ones, their places and sizes, and says which are changed. The others never become Python rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbering(key)
        for batch, starts in whole_runs(batches, opening()):
            size = np.diff(np.append(starts, batch.num_rows))
            chosen = some(batch, starts, size)
            if chosen.any():
                batch = changed(batch, np.repeat(np.arange(len(size)), size), chosen, size)
            if batch.num_rows:
                at = batch.schema.get_field_index("seq")
                seq = pa.array(number(batch, np.ones(batch.num_rows, bool))).cast(batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), seq)

    def changed(batch: pa.RecordBatch, stretch: np.ndarray, chosen: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        mask = chosen[stretch]
        given, units = with_units(batch.filter(pa.array(mask)))
        out: list[dict] = []
        where: list[int] = []
        ends = np.cumsum(size[chosen]).tolist()
        for k, lo, hi in zip(np.flatnonzero(chosen).tolist(), [0, *ends], ends, strict=False):
            found = change(given[lo:hi])
            out += found
            where += [k] * len(found)
        ends = pa.array([0, *[r["word_data"].hi for r in out]], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, units).cast(f.type) if f.name == "word_data" else pa.array([r[f.name] for r in out], f.type, from_pandas=True) for f in batch.schema]
        done = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        both = pa.concat_batches([batch.filter(pa.array(~mask)), done])
        return both.take(pa.array(np.argsort(np.concatenate([stretch[~mask], np.array(where, np.int64)]), kind="stable")))

    return rows.mapInArrow(run, schema)


def carried(rows: DataFrame, keys: list[str], order: list[str], read: list[str], write: dict[str, str], start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Columns ``write`` (name to type) from a step that is taken row by row, in order, within each key.

    ``start`` gives a fresh step for each key; it gets the columns ``read`` of a row, keeps
    what it has to in itself, and returns the new values. Rows stream through: a task holds a
    batch and the step's own state, so time is in proportion however long a key's rows are.
    """
    kept = [c for c in rows.columns if c not in write]
    keyed = rows.withColumn("_g", F.xxhash64(*keys)).repartition("_g").sortWithinPartitions("_g", *keys, *order)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{c}` {t}" for c, t in write.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            found = []
            values = zip(*[batch.column(c).to_pylist() for c in read], strict=True)
            for g, row in zip(batch.column("_g").to_pylist(), values, strict=True):
                if step is None or g != key:
                    key, step = g, start()
                found.append(step(*row))
            new = [pa.array([f[i] for f in found], from_ddl(t)) for i, t in enumerate(write.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, *write])

    from_ddl = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}.__getitem__
    return keyed.mapInArrow(run, schema).select(*[c for c in rows.columns if c not in write], *write)


def computed(rows: DataFrame) -> DataFrame:
    """The same rows; later filters and columns read the values instead of working them out again wherever they are named.

    Track and seq pass beside them, so that rows which were dealt out by track and sorted still count as such.
    """
    keys = [c for c in ("track_id", "seq") if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.inline(F.array(F.struct(*rest)))).select(rows.columns) if rest else rows


def changes(*columns: pa.Array) -> np.ndarray:
    """Places at which a row differs from the one before in any column; the first row's among them."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            a, b = c.slice(1), c.slice(0, n - 1)
            new[1:] |= pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _fields(schema: str) -> list[str]:
    """The fields of a schema text; commas inside of brackets do not part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def spelled(df: DataFrame, *more: str) -> str:
    """A frame's schema as text, with further fields."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more))
