"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from cuegrid.llm.conversation_repair import Repair, digests

LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0d]+", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))

    @cache
    def search(t, state, inserted):
        options = [(0, "", ())] if t == len(rows) and LEGAL.fullmatch(state) else []
        moves = []
        if t < len(rows):
            role, text = rows[t][2:]
            extra = 3 if faults[t] == "truncated" else 0
            moves.append((4, "D", t + 1, "", None))
            if faults[t] not in ("blank", "duplicate"):
                moves.append((extra, "K", t + 1, role[:1] or "?", f"{role}:{text}"))
                moves += [(3 + extra, "R", t + 1, x[0], f"{x}:{text}") for x in ("user", "assistant")]
        if inserted < 3:
            moves += [(3, "I", t, x[0], f"{x}:") for x in ("user", "assistant")]
        for cost, letter, at, initial, line in moves:
            now = state + initial
            if any(LEGAL.fullmatch(now + x) for x in ("", "a", "ua")):
                # what the rule remembers: nothing, s, an open or a closed pair
                now = now if len(now) <= 1 else ("u" if now[-1] == "u" else "ua")
                rest = search(at, now, inserted + 1 if at == t else 0)
                if rest is not None:
                    options.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(options) if options else None

    cost, audit, lines = search(0, "", 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "so", "", " \t", "Why?", "a b. ", "x\ny", None]
    out = []
    for c in range(n):
        for _ in range(r.randrange(0, 11)):
            out.append((None if c == 0 else c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts)))
    return out


def found(spark, rows, segment=4096, extra=()):
    schema = "conv_id long, turn long, role string, text string" + "".join(f", {c} string" for c in extra)
    df = spark.createDataFrame([r + ("x",) * len(extra) for r in rows], schema)
    repair = Repair(df, segment)
    out = repair.report().join(digests(repair.repaired()), "start", "left").collect()
    keys = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (*(r[k] for k in keys), r["repaired_sha256"] or hashlib.sha256(b"").hexdigest()) for r in out}


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)))
    return {c: plain(x) for c, x in out.items()}


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair_is_the_cheapest_and_least(spark, segment):
    rows = conversations(segment, 120)
    assert found(spark, rows, segment, ["start", "rn", "code", "fault", "a"]) == by_conversation(rows)


def test_one_long_conversation_is_worked_on_in_segments(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "user", "assistant", "system"]), f"{t}{r.choice(['.', '.', ''])}") for t in range(3000)]
    whole, cut = found(spark, rows), found(spark, rows, 64)
    assert whole == cut and len(whole[7][6]) >= 3000


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    from cuegrid.llm.queries import op11_conversation_repair

    rows = conversations(9, 60) + [(c, 0, "user", "Yes.") for c in range(100, 160)]  # some of these are dropped whole
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = by_conversation(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: hurt.get(c, nothing) for c in {r[0] for r in rows}}
    assert nothing in got.values()
