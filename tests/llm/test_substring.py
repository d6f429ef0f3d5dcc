"""Repeated passages against plain window sets."""

import hashlib
import random

import pyarrow as pa
import pytest

from cuegrid.llm.substring_index import Stretches, SubstringIndex, remove_repeats
from cuegrid.llm.textscan import run_hashes

from . import brute

SCHEMA = "doc_id long, text string, fp long, spans string"


def passages(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    fresh = lambda n: r.choices(vocabulary, k=n)
    common = [fresh(n) for n in (49, 50, 51, 70, 120, 300)]
    rows = [(900, None), (901, ""), (902, " ".join(fresh(49))), (903, "same " * 200), (904, "same " * 130 + "end"), (905, "a b " * 90)]
    for d in r.sample(range(800), 90):
        text = fresh(r.choice([0, 10, 60, 200]))
        for _ in range(r.choice([0, 1, 1, 2])):
            p = list(r.choice(common))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            if r.random() < 0.4:
                p = p[r.randrange(20) :]
            text = text + p + fresh(r.choice([0, 5, 40]))
        rows.append((d, r.choice([" ", "\n", "  "]).join(text)))
    rows.append((950, rows[20][1]))
    rows.append((951, " ".join(vocabulary[i % 62] + str(i // 62) for i in range(30_000))))
    rows.append((952, rows[-1][1]))
    return rows


def check(got, rows):
    want = brute.repeated_windows(rows)
    assert len(got) == len(rows)
    for g in got:
        n, gone, kept = want[g["doc_id"]]
        assert (g["n_words"], g["n_removed"]) == (n, gone), g["doc_id"]
        assert g["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert g["kept"] == (" ".join(kept) if gone else None)
    assert sum(w[1] for w in want.values()) > 1000


@pytest.mark.parametrize("batches", [1, 6])
def test_equals_plain(spark, batches):
    rows = passages(batches)
    frame = spark.createDataFrame([(d, t, 1, "") for d, t in rows], SCHEMA).repartition(3)
    check(remove_repeats(frame, batches).collect(), rows)


def test_index_over_arbitrary_batches(spark, monkeypatch):
    """Earlier batches count as seen whatever their ids, also after the runs are merged."""
    monkeypatch.setattr("cuegrid.llm.substring_index.MOST_RUNS", 1)
    rows = passages(5)
    random.Random(1).shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    order = {d: (k, d) for k, part in enumerate(parts) for d, _ in part}
    index, got, seen = SubstringIndex(spark), [], []
    for part in parts:
        seen += part
        got += index.add(spark.createDataFrame([(d, t, 0, "") for d, t in part], SCHEMA), spark.createDataFrame([(d, t, 0, "") for d, t in seen], SCHEMA)).collect()
    want = brute.repeated_windows([(order[d], t) for d, t in rows])
    assert {g["doc_id"]: g["n_removed"] for g in got} == {d: want[order[d]][1] for d, _ in rows}
    assert len(index.runs) <= 2


def test_a_later_session_goes_on_and_runs_are_joined_in_place(spark, tmp_path):
    rows = sorted(passages(7))
    parts, got = [rows[:40], rows[40:70], rows[70:]], []
    frame = lambda rs: spark.createDataFrame([(d, t, 0, "") for d, t in rs], SCHEMA)
    for k, part in enumerate(parts):
        index = SubstringIndex(spark, str(tmp_path / "index"))
        assert index.batches == k
        got += index.add(frame(part), frame([r for p in parts[: k + 1] for r in p])).collect()
    check(got, rows)
    index = SubstringIndex(spark, str(tmp_path / "index"))
    with index._in_order():
        plan = index._known(index._run("2"), index._run, ["fp", "hi", "lo"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort " not in plan


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(80)))
    frame = spark.createDataFrame([(4, text, 0, ""), (4, text, 0, ""), (None, text, 0, ""), (7, text, 0, "")], SCHEMA)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in remove_repeats(frame).collect()), key=str)
    assert got == sorted([(4, 0), (4, 0), (None, 0), (7, 80)], key=str)
    assert remove_repeats(frame.where("false")).count() == 0


def test_run_hashes_depend_on_words_only():
    a = Stretches(pa.array(["x y z " * 40]))
    first = run_hashes(a.h[0], a.start[:1], a.start[:1] + 30)
    again = run_hashes(a.h[0], a.start[:1] + 3, a.start[:1] + 33)
    assert first == again
