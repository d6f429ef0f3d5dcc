"""Spherical-cap filters against all pairs."""

import numpy as np
import pytest

from cuegrid.llm import embedding_dedup
from cuegrid.llm.embedding_dedup import decode, linked_vectors

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, links string, node int"


def vectors(seed=0, dim=24):
    r = np.random.default_rng(seed)
    rows = []
    base = r.standard_normal((40, dim))
    for k in range(700):
        v = base[r.integers(0, 40)] * r.uniform(0.1, 3) + r.standard_normal(dim) * r.choice([0.0, 0.02, 0.12, 0.3])
        rows.append((int(k * 37 % 997), [float(np.float32(x)) for x in v], int(r.integers(0, 3))))
    one = rows[3][1]
    rows += [(2000 + i, one, rows[3][2]) for i in range(30)]
    rows += [(3000 + i, [float(np.float32(x)) for x in base[0] + r.standard_normal(dim) * 0.03], 1) for i in range(120)]
    odd = [None, [0.0] * dim, [1.0, None, *[0.0] * (dim - 2)], [float("nan"), *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)], [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(4000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(5000, one, None), (5001, one, None)]
    return rows


def plain(rows, least=0.98):
    def fit(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if fit(v, g) else None for _, v, g in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    comp, n, low = brute.closest_components(len(rows), links), [0] * len(rows), {}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for c, (d, *_) in zip(comp, rows):
        low[c] = min(d, low.get(c, d))
    return {d: (n[i], low[comp[i]]) for i, (d, *_) in enumerate(rows)}


@pytest.mark.parametrize("unit_rows", [256, 20])
def test_links_equal_all_pairs(spark, monkeypatch, unit_rows):
    monkeypatch.setattr(embedding_dedup, "UNIT_ROWS", unit_rows)
    rows = vectors()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in linked_vectors(frame).collect()}
    assert got == plain(rows)
    assert any(n > 100 for n, _ in got.values())


def test_batches_of_large_units_alone(spark, monkeypatch):
    """No unit is left for the comparison row by row."""
    monkeypatch.setattr(embedding_dedup, "LARGE_UNIT", 1)
    rows = [(i, [1.0, 0.01 * i, 0.5], 0) for i in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == plain(rows)


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    for dim, codewords in ((64, 256), (64, 900), (300, 500)):
        x = r.standard_normal((1500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = r.standard_normal((1500, dim))
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
        (a, f), (b, g) = decode(x, codewords, 0.98), decode(y, codewords, 0.98)
        shared = np.isin(a * codewords**2 + f, b * codewords**2 + g)
        assert len(np.unique(a[shared])) > 0.998 * 1500


def test_decoding_finds_every_filter_above_the_threshold():
    r = np.random.default_rng(5)
    for dim, codewords in ((5, 7), (24, 40)):
        x = r.standard_normal((60, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn, (left, right) = embedding_dedup.code(dim, codewords)
        y = x @ turn
        cut = left.shape[1]
        score = ((y[:, :cut] @ left.T)[:, :, None] + (y[:, cut:] @ right.T)[:, None, :]).reshape(60, -1)
        least = score.max(axis=1, keepdims=True) - embedding_dedup.MARGIN * np.sqrt(2 * 0.02 / dim)
        row, number = decode(x, codewords, 0.98)
        assert sorted(zip(row.tolist(), number.tolist())) == list(zip(*[v.tolist() for v in np.nonzero(score >= least)]))


def test_long_vectors_and_ties(spark):
    """Vectors of 3,000 components, equal ones and exact multiples."""
    r = np.random.default_rng(8)
    base = r.standard_normal((4, 3000))
    rows = [(10 * k + c, [float(x) for x in base[k] * (2.0**c)], 1) for k in range(4) for c in range(3)]
    rows.append((99, [float(x) for x in base[0] + 0.1 * r.standard_normal(3000)], 1))
    frame = spark.createDataFrame([(*v, "", 0) for v in rows], "vec_id long, embedding array<double>, label int, links string, node int")
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in linked_vectors(frame).collect()}
    assert got == plain(rows)


def test_nulls_repeats_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    frame = spark.createDataFrame([(None, v, 1, "", 0), (5, v, 1, "", 0), (5, v, 1, "", 0), (3, v, 1, "", 0)], SCHEMA)
    got = sorted(map(tuple, linked_vectors(frame).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (5, 1, 3, False), (5, 1, 3, False), (3, 1, 3, True)], key=str)
    assert linked_vectors(frame.where("false")).count() == 0
