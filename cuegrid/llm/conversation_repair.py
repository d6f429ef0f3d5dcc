"""Cheapest repair of conversations: a tensor program over turns, batched by length.

Rows get their place in their conversation by range partitioning, so a conversation of any
length is spread over tasks. Conversations are cut into segments of bounded length and each
becomes a line of small codes. Lines of about the same length are stacked time-major; the
costs of all of them are worked out backward, one turn of every line at a time, stored, and
the edits are then traced forward in the same way. A long conversation's segments are joined
by their cost matrices (states at the start by states at the end), so all of its segments
are worked on at once; only the chain of these small matrices is followed in order.

Edits are written ``d`` (delete), ``u`` and ``a`` (insert a user or assistant turn), ``k``
(keep), ``U`` and ``A`` (keep, as user or assistant); in an audit D, I, K and R.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import whole_groups
from .common import Workspace, ranked

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows of a segment, and cells (rows by lines) of one stack.
SEGMENT, CELLS = 4096, 1 << 19
#: States: nothing yet, after a system turn, a user turn, an assistant turn. Ends: the first and the last.
_INSERTED = np.array([2, 2, 3, 2])
_NONE = 4
#: The state after keeping a row with initial s, u, a or any other, by state.
_KEPT = np.array([[1, _NONE, _NONE, _NONE], [2, 2, _NONE, 2], [_NONE, _NONE, 3, _NONE], [_NONE] * 4])
_FAR = 1 << 28
#: Costs from each state at the end of a conversation, and the turns that these insert.
_END, _TAIL = [0, 2 * INSERT, INSERT, 0], ["", "ua", "a", ""]
_MUST_GO, _CUT_SHORT = 4, 8


def backward_costs(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (turn, line, state) from before each turn to the end of its line.

    ``codes`` is turns by lines, ``ends`` the costs of the states after a line's last turn.
    """
    turns, lines = codes.shape
    out = np.empty((turns + 1, lines, 4), np.int32)
    out[turns] = ends
    each = np.arange(lines)[:, None]
    after = np.full((lines, 5), _FAR, np.int32)
    for t in range(turns - 1, -1, -1):
        after[:, :4] = out[t + 1]
        code = codes[t]
        extra = np.where(code & _CUT_SHORT, TRUNCATED, 0)[:, None]
        stay = np.minimum(after[each, _KEPT[code & 3]], after[:, _INSERTED] + REROLE) + extra
        best = np.where((code & _MUST_GO)[:, None] > 0, _FAR, stay)
        best = np.minimum(best, after[:, :4] + DELETE)
        for _ in range(2):  # a third turn in one place never pays
            best = np.minimum(best, best[:, _INSERTED] + INSERT)
        out[t] = np.minimum(np.where((t < lengths)[:, None], best, after[:, :4]), _FAR)
    return out


def traced(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray, entry: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(edits, state after the last turn) of every line; of equally cheap edits the least in the order d, insert, k, rerole."""
    turns, lines = codes.shape
    out = np.zeros((turns, 3, lines), np.uint8)
    state, each = entry.copy(), np.arange(lines)
    for t in range(turns):
        here, after, code = costs[t], np.concatenate([costs[t + 1], np.full((lines, 1), _FAR, np.int32)], axis=1), codes[t]
        live = t < lengths
        for k in range(2):
            now, to = here[each, state], _INSERTED[state]
            put = live & (after[each, state] + DELETE != now) & (here[each, to] + INSERT == now)
            out[t, k] = np.where(put, np.where(to == 2, ord("u"), ord("a")), 0)
            state = np.where(put, to, state)
        now, to = here[each, state], _INSERTED[state]
        extra = np.where(code & _CUT_SHORT, TRUNCATED, 0)
        gone = after[each, state] + DELETE == now
        kept = ~gone & (after[each, _KEPT[code & 3, state]] + extra == now) & ((code & _MUST_GO) == 0)
        changed = ~gone & ~kept
        letter = np.where(gone, ord("d"), np.where(kept, ord("k"), np.where(to == 2, ord("U"), ord("A"))))
        out[t, 2] = np.where(live, letter, 0)
        state = np.where(live & kept, _KEPT[code & 3, state], np.where(live & changed, to, state))
    flat = out.reshape(-1, lines).T
    return [row[row > 0].tobytes().decode() for row in flat], state


def _stacks(lines: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which lines, codes time-major, lengths) by powers of two of the length."""
    offsets, values = lines.offsets.to_numpy(), lines.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    power = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for p in np.unique(power):
        which = np.flatnonzero(power == p)
        step = max(1, CELLS >> int(p))
        for lo in range(0, len(which), step):
            pick = which[lo : lo + step]
            n = lengths[pick]
            at = offsets[pick][None, :] + np.minimum(np.arange(n.max())[:, None], n - 1)
            yield pick, values[at].astype(np.uint8), n


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and cost of conversations that are one segment."""
    for batch in batches:
        edits, cost = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
        for pick, codes, n in _stacks(batch.column("codes")):
            costs = backward_costs(codes, n, np.tile(np.int32(_END), (len(pick), 1)))
            found, state = traced(codes, n, costs, np.zeros(len(pick), int))
            cost[pick] = costs[0, :, 0]
            for i, e, s in zip(pick, found, state, strict=True):
                edits[i] = e + _TAIL[s]
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("seg"), pa.array(edits, pa.string()), pa.array(cost)], ["start", "seg", "edits", "cost"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs of each segment from every state to every state, by state at the start."""
    one = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int32)
    for batch in batches:
        m = np.zeros((batch.num_rows, 4, 4), np.int64)
        for pick, codes, n in _stacks(batch.column("codes")):
            for x in range(4):
                m[pick, :, x] = backward_costs(codes, n, np.tile(one[x], (len(pick), 1)))[0]
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("seg"), pa.array(m.reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["start", "seg", "m"])


def _segment_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the costs of the states behind it; for the first also the cost of all."""
    for batch in whole_groups(batches, ["start"]):
        start, seg = batch.column("start").to_pylist(), batch.column("seg").to_pylist()
        m = np.array(batch.column("m").to_pylist()).reshape(-1, 4, 4)
        ends, cost = np.zeros((len(seg), 4), np.int64), np.zeros(len(seg), np.int64)
        for i in range(len(seg) - 1, -1, -1):
            last = i + 1 == len(seg) or start[i + 1] != start[i]
            ends[i] = _END if last else (m[i + 1] + ends[i + 1]).min(axis=1)
            cost[i] = (m[i] + ends[i]).min(axis=1)[0] if seg[i] == 0 else 0
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("seg"), pa.array(ends.tolist(), pa.list_(pa.int64())), pa.array(cost)], ["start", "seg", "ends", "cost"])


def _every_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and end state of each segment for each state it may begin in."""
    for batch in batches:
        ends = np.array(batch.column("ends").to_pylist())
        ends = np.minimum(ends - ends.min(axis=1, keepdims=True), _FAR)
        edits, state = [[""] * 4 for _ in range(batch.num_rows)], np.zeros((batch.num_rows, 4), np.int64)
        for pick, codes, n in _stacks(batch.column("codes")):
            costs = backward_costs(codes, n, ends[pick].astype(np.int32))
            for s in range(4):
                found, state[pick, s] = traced(codes, n, costs, np.full(len(pick), s))
                for i, e in zip(pick, found, strict=True):
                    edits[i][s] = e
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("seg"), batch.column("cost"), pa.array(edits), pa.array(state.tolist(), pa.list_(pa.int64()))], ["start", "seg", "cost", "edits", "state"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each segment begins in, and whether it is its conversation's last, with its end state."""
    for batch in whole_groups(batches, ["start"]):
        start, states = batch.column("start").to_pylist(), batch.column("state").to_pylist()
        entry, left, now = [], [], 0
        for i, s in enumerate(states):
            now = 0 if i == 0 or start[i] != start[i - 1] else now
            entry.append(now)
            now = s[now]
            left.append(_TAIL[now] if i + 1 == len(states) or start[i + 1] != start[i] else "")
        yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("seg"), pa.array(entry, pa.int32()), pa.array(left, pa.string())], ["start", "seg", "entry", "tail"])


def cheapest_edits(ws: Workspace, lines: DataFrame, longer: bool) -> DataFrame:
    """start, seg, edits and cost (on the first segment, else 0) of lines (start, seg, segs, codes)."""
    kind = "start long, seg long"
    out = lines.where("segs = 1").select("start", "seg", "codes").mapInArrow(_whole_lines, f"{kind}, edits string, cost long")
    if not longer:
        return out
    cut = lines.where("segs > 1").select("start", "seg", "codes")
    matrices = cut.mapInArrow(_matrices, f"{kind}, m array<long>")
    # sixteen numbers for 4096 rows: all of one conversation's fit a task
    ends = by_start(matrices).mapInArrow(_segment_ends, f"{kind}, ends array<long>, cost long")
    every = ws.save(cut.join(ends, ["start", "seg"]).mapInArrow(_every_entry, f"{kind}, cost long, edits array<string>, state array<long>"), "every")
    entry = by_start(every.select("start", "seg", "state")).mapInArrow(_entries, f"{kind}, entry int, tail string")
    chosen = every.join(entry, ["start", "seg"])
    return out.unionByName(chosen.select("start", "seg", F.concat(F.col("edits")[F.col("entry")], "tail").alias("edits"), "cost"))


def by_start(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order."""
    return rows.repartition("start").sortWithinPartitions("start", "seg")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


class Repair:
    """Faults of conversations and the cheapest edits that mend them.

    ``rows`` needs conv_id, turn, role and text; other columns are ignored. A null role or
    text is one space, a null conv_id a conversation of its own; rows are taken by turn,
    nulls first, then role and text. Blank rows and rows whose role and text were seen
    earlier must go; cut-short rows (last sign not a full stop, exclamation or question
    mark) cost something if they stay. Very long conversations are worked on in segments,
    with the same result. Repeated rows are duplicates. An empty table has no conversations.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT):
        self.ws = Workspace(rows.sparkSession, "repair")
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        slim = rows.select("conv_id", "turn", space("role"), space("text"))
        order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
        placed = self.ws.save(ranked(self.ws, slim, order, {}, "dealt"), "placed")
        heads = placed.groupBy("conv_id").agg(F.min("rn").alias("start"), F.count(F.lit(1)).alias("n"))
        heads = self.ws.save(heads.withColumn("segs", F.ceil(F.col("n") / segment)), "heads")
        placed = placed.withColumnRenamed("conv_id", "_conv").join(heads, F.col("_conv").eqNullSafe(F.col("conv_id"))).drop("_conv")
        key = F.sha2(F.concat_ws(":", "start", F.octet_length("role"), "role", "text"), 256)
        placed = self.ws.save(placed.withColumn("key", F.unhex(key)), "keyed")
        first = placed.groupBy("key").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
        last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
        fault = F.when(last == "", "blank").when(F.col("rn") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
        code = _initial(F.col("role")) + F.when(F.col("fault").isin("blank", "duplicate"), _MUST_GO).when(F.col("fault") == "truncated", _CUT_SHORT).otherwise(0)
        judged = placed.join(first.drop("times"), "key", "left").withColumn("fault", fault).withColumn("code", code)
        pos = F.col("rn") - F.col("start")
        self.rows = self.ws.save(judged.select("conv_id", "start", "segs", "rn", F.floor(pos / segment).alias("seg"), "turn", "role", "text", "fault", "code"), "rows")
        coded = F.sort_array(F.collect_list(F.struct("rn", "code")))
        lines = self.rows.groupBy("start", "seg", "segs").agg(coded.alias("c"))
        lines = self.ws.save(lines.withColumn("codes", F.transform("c", lambda x: x["code"])).drop("c"), "lines")
        longer = heads.agg(F.max("segs")).first()[0] or 0
        self.edits = self.ws.save(cheapest_edits(self.ws, lines, longer > 1), "edits")
        self.lines, self.longer = lines, longer > 1

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation."""
        of = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
        counts = self.rows.groupBy("start", "conv_id").agg(gaps.alias("gaps"), *map(of, ("blank", "duplicate", "truncated")))
        c = F.transform("codes", lambda x: x % 4)
        legal = lambda a, b: F.concat(a, b).isin("01", "12", "21")
        wrong = F.size(F.filter(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: b.isNotNull() & ~legal(a, b)), lambda x: x)).cast("long")
        ends = self.lines.select("start", "seg", "segs", wrong.alias("wrong"), F.element_at(c, 1).alias("head"), F.element_at(c, -1).alias("last"))
        across = ends.where("segs > 1").alias("a").join(ends.where("segs > 1").alias("b"), F.expr("a.start = b.start AND a.seg + 1 = b.seg"))
        across = across.where(~legal(F.col("a.last"), F.col("b.head"))).select("a.start", F.lit(1).cast("long").alias("wrong"))
        illegal = ends.select("start", "wrong").unionByName(across).groupBy("start").agg(F.sum("wrong").alias("illegal"))
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "")
        audits = self.edits.groupBy("start").agg(F.sum("cost").alias("cost"), F.translate(text, "duakUA", "DIIKRR").alias("audit"))
        return counts.join(illegal, "start").join(audits, "start")

    def repaired(self) -> DataFrame:
        """The rows of the repaired conversations: conv_id, start, rn, k, edit, turn, role, text; inserted rows have a null turn.

        ``start``, ``rn`` and ``k`` order them; ``edit`` is k, u, a, U or A as in the module's text.
        """
        steps = F.posexplode(F.regexp_extract_all("edits", F.lit("[ua]*[dkUA](?:[ua]+$)?"), 0)).alias("p", "step")
        first = self.rows.groupBy("start", "seg").agg(F.min("rn").alias("rn0"))
        per_row = self.edits.join(first, ["start", "seg"]).select("rn0", steps).select((F.col("rn0") + F.col("p")).alias("rn"), "step")
        each = self.rows.join(per_row, "rn").select("*", F.posexplode(F.split("step", "")).alias("k", "edit")).where("edit NOT IN ('d', '')")
        new = F.col("edit").isin("u", "a")
        role = F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role"))
        return each.select("conv_id", "start", "rn", "k", "edit", F.when(~new, F.col("turn")).alias("turn"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """start and sha256 of the newline-joined ``role:text`` of each conversation's ``repaired`` rows.

    The hash runs over a conversation's rows in order, so they stream through one task;
    none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for start, line in zip(batch.column("start").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if start != at:
                    if hashed is not None:
                        done.append((at, hashed.hexdigest()))
                    at, hashed = start, hashlib.sha256(line.encode())
                else:
                    hashed.update(b"\n")
                    hashed.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], ["start", "repaired_sha256"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([hashed.hexdigest()])], ["start", "repaired_sha256"])

    lines = rows.select("start", "rn", "k", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("start").sortWithinPartitions("start", "rn", "k").select("start", "line").mapInArrow(run, "start long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with seeded damage by conversation and turn.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls
    count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
