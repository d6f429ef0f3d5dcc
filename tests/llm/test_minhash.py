"""MinHash near-duplicates, components and block pairs against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from cuegrid.llm import blocks, minhash
from cuegrid.llm.common import Workspace
from cuegrid.llm.components import connected_components

from . import brute

SCHEMA = "doc_id long, text string, node long, bands string"


def near_corpus(seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one two three"), (906, "é ü ö ä ß ñ")]
    k = 0
    for base in range(30):
        words = r.choices(vocabulary, k=r.choice([6, 30, 120, 600]))
        for copy in range(r.choice([1, 2, 5, 25])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, len(own) // 40, len(own) // 10])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            text = " ".join(own)
            rows.append((k * 7 % 899, text.upper() if copy % 4 == 3 else text))
            k += 1
    rows.append((950, " ".join(r.choices(vocabulary, k=50_000))))
    rows.append((951, rows[-1][1] + " tail"))
    return [(d, t) for d, t in dict(rows).items()]


def test_near_duplicates_equal_plain(spark, monkeypatch):
    rows = near_corpus()
    frame = spark.createDataFrame([(d, t, 5, "clash") for d, t in rows], SCHEMA).repartition(4)
    for block, percent in ((64, 85), (3, 80)):
        want = brute.near_components(rows, percent)
        monkeypatch.setattr(minhash, "SET_BLOCK", block)
        monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", block)
        monkeypatch.setattr(minhash, "PAIRED_BLOCK", 4 * block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, percent).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 50


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f g h i j"
    frame = spark.createDataFrame([(None, text, 0, ""), (4, text, 0, ""), (4, text, 0, ""), (2, text.upper(), 0, "")], SCHEMA)
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame).collect())
    assert got == {(None, 6, None, True): 1, (4, 6, 2, False): 2, (2, 6, 2, True): 1}
    assert minhash.near_duplicates(frame.where("false")).count() == 0


def test_estimate_is_corrected(spark):
    r = np.random.default_rng(0)
    common, own = r.integers(0, 1 << 63, 900).astype(np.uint64), r.integers(0, 1 << 63, 200).astype(np.uint64)
    a, b = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
    m = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    bits = minhash.pack_bits(m)
    assert abs(minhash.estimate(bits[:1], bits[1:])[0] - 900 / 1100) < 0.12
    assert minhash.estimate(bits[:1], bits[:1])[0] == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, tmp_path, seed):
    r = random.Random(seed)
    n = 400
    links = [(r.randrange(n), r.randrange(n)) for _ in range([100, 300, 40][seed])] + [(i, i + 1) for i in range(300, 360)]
    frame = spark.createDataFrame(links, "x long, y long")
    got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "t"), frame).collect()}
    want = brute.closest_components(n, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


@pytest.mark.parametrize("seed", range(20))
def test_forest(seed):
    r = np.random.default_rng(seed)
    n = 300
    i, j = r.integers(0, n, (2, int(r.integers(1, 500))))
    chain = np.arange(0, 100)
    given = [*zip(i.tolist(), j.tolist()), *zip(chain[1:].tolist(), chain[:-1].tolist())]
    tree = blocks.Forest(n)
    tree.add(i, j)
    tree.add(chain[1:], chain[:-1])
    kept = list(zip(*[x.tolist() for x in tree.links()]))
    want = brute.closest_components(n, given)
    assert tree.label.tolist() == want == brute.closest_components(n, kept)
    assert set(kept) <= set(given) and len(kept) == n - len(set(want))


def test_overlaps():
    r = random.Random(0)
    sets = [np.unique(np.array(r.choices(range(300), k=k), np.uint64)) for k in (5, 100, 1, 250, 30)]
    got = blocks.overlaps(sets, step=64)
    for a in range(5):
        for b in range(5):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_no_components(spark):
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "x long, y long")).count() == 0
