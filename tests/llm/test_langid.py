"""The byte network: gradients, fast pooling, coverage of whole texts, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from cuegrid.llm import langid
from cuegrid.llm.langid import FILTERS, WIDTHS, WINDOW, cut, fit, pooled, predict, train

SCHEMA = "doc_id long, text string, lang string, score string, letter int"
WORDS = {
    "en": "the of and to in is that it was for with his they be this from have or by one had not but what all were when we there can".split(),
    "de": "der die und das nicht ist ein ich sie mit sich auf für eine auch werden über schön größer können müssen straße".split(),
    "fr": "le la les des une est que pour dans qui par pas sur être avec été cette leur même où déjà très français".split(),
}


def corpus(n=900, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        text = " ".join(r.choices(WORDS[lang], k=r.choice([8, 40, 300])))
        rows.append((i, text, lang if r.random() < 0.8 else None, "", 0))
    return rows


def small_net():
    rows = corpus(120)
    return train([t for _, t, *_ in rows], [x or "en" for _, _, x, *_ in rows], epochs=1)


def test_gradients_match_differences():
    rows = corpus(6, 3)
    net = small_net()
    x = np.zeros((6, WINDOW), np.uint8)
    for i, (_, t, *_) in enumerate(rows):
        b = np.frombuffer(t.encode()[:WINDOW], np.uint8)
        x[i, : len(b)] = b
    y, weight = np.array([0, 1, 2, 0, 1, 2]), np.ones(3)
    params = [net.embed, *net.filters, net.bias, net.dense, net.dense_bias]
    for k, p in enumerate(params):
        params[k] = p.astype(np.float64)
    net.embed, net.filters, (net.bias, net.dense, net.dense_bias) = params[0], params[1:4], params[4:]

    def loss():
        tops = []
        for f in net.filters:
            n = WINDOW - len(f) + 1
            e = net.embed[x]
            tops.append((np.concatenate([e[:, i : i + n] for i in range(len(f))], axis=2) @ f.reshape(-1, FILTERS)).max(axis=1))
        return -langid.log_probs(net, np.concatenate(tops, axis=1))[np.arange(6), y].mean()

    grads = langid._gradients(net, x, y, weight)
    r = np.random.default_rng(0)
    for p, g in zip(params, grads):
        for _ in range(5):
            at = tuple(r.integers(0, s) for s in p.shape)
            if p is net.embed:
                at = (ord("e"), at[1])
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_pooling_equals_plain_convolution():
    net = small_net()
    w = np.random.default_rng(1).integers(0, 256, (5, WINDOW)).astype(np.uint8)
    got = pooled(w, net.pair_tables())
    for k, f in enumerate(net.filters):
        want = np.stack([[sum(net.embed[row[t + i]] @ f[i] for i in range(WIDTHS[k])) for t in range(WINDOW - WIDTHS[k] + 1)] for row in w]).max(axis=1)
        assert np.allclose(got[:, k * FILTERS : (k + 1) * FILTERS], want, atol=1e-4)


@pytest.mark.parametrize("lens", [[0, 1, 255, 256, 257, 509, 510, 3000], [0], [5]])
def test_windows_cover_everything(lens):
    data = np.random.default_rng(0).integers(1, 256, sum(lens)).astype(np.uint8)
    bounds = np.concatenate(([0], np.cumsum(lens)))
    windows, row = cut(data, bounds)
    for r, n in enumerate(lens):
        own = windows[row == r]
        text = data[bounds[r] : bounds[r + 1]]
        grams = {bytes(text[i : i + 4]) for i in range(n - 3)}
        assert grams <= {bytes(w[i : i + 4]) for w in own for i in range(WINDOW - 3)}
        assert (len(own) > 0) == (n > 0)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    truth = {d: max(WORDS, key=lambda g: sum(w in WORDS[g] for w in t.split())) for d, t, *_ in rows}
    odd = [(9000, None, "en", "", 0), (9001, "", "en", "", 0), (9002, "12 #!", "de", "", 0), (None, "the of and", "en", "", 0)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    net = fit(frame, per_lang=200)
    assert net.languages == ["de", "en", "fr"]
    got = predict(frame, net).collect()
    assert len(got) == len(rows) + 4
    by = {r["doc_id"]: r for r in got}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([by[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (9000, 9001, 9002))
    assert by[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)


def test_sample_leaves_the_held_out_fold(spark):
    frame = spark.createDataFrame([(i, f"word{i}", "en", "", 0) for i in range(200)], SCHEMA)
    held = {f"word{i}" for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    pieces = {r["piece"] for r in langid.labelled_sample(frame, 1000).collect()}
    assert len(pieces) == 200 - len(held) and not pieces & held


def test_sample_of_a_hot_language_is_full_and_bounded(spark):
    rows = [(i, f"text number {i}", "hot" if i % 50 else "rare", None, 0) for i in range(6000)]
    frame = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang")
    per_lang = 200
    got = langid.labelled_sample(frame, per_lang).groupBy("lang").count().collect()
    rare = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 6000, 50))
    assert {r["lang"]: r["count"] for r in got} == {"hot": per_lang, "rare": rare}


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "abc", None, "", 0)], SCHEMA)
    assert fit(frame) is None
    assert predict(frame, None).first()["lang_pred"] == "und"
    assert predict(frame.where("false"), small_net()).count() == 0


def plain_prediction(net, text):
    """Every window by itself, the convolution written out, log-probabilities averaged."""
    raw, stride = (text or "").encode(), WINDOW - langid.OVERLAP
    at, sums = 0, []
    while True:
        window = np.zeros(WINDOW, np.uint8)
        piece = np.frombuffer(raw[at : at + WINDOW], np.uint8)
        window[: len(piece)] = piece
        e = net.embed[window].astype(np.float64)
        top = np.concatenate([sum(e[i : WINDOW - len(f) + 1 + i] @ f[i].astype(np.float64) for i in range(len(f))).max(axis=0) for f in net.filters])
        z = np.maximum(top + net.bias, 0) @ net.dense.astype(np.float64) + net.dense_bias
        sums.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
        if at + WINDOW >= len(raw):
            break
        at += stride
    p = np.exp(np.mean(sums, axis=0))
    return p / p.sum()


def test_predictions_equal_plain(spark):
    """Whole texts, one of a megabyte, repeated rows, several scripts, and a network that cannot decide."""
    r = np.random.default_rng(14)
    net = small_net()
    words = ["haus", "the", "île", "вода", "山", "x1", "\n", "of"]
    texts = ["a", "no", " ".join(r.choice(words, 40)), " ".join(r.choice(words, 3000)), " ".join(r.choice(words, 40)), "ß" * 257] + [" ".join(r.choice(words, k)) for k in (60, 61, 62, 63, 64, 130)]
    texts += [texts[2], "lorem " * 180_000]
    rows = [(i, t, "en", "", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {x["doc_id"]: x for x in predict(frame, net).collect()}
    for i, t in enumerate(texts):
        p = plain_prediction(net, t)
        assert got[i]["lang_pred"] == net.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-3, i
    net.dense[:] = 0
    net.dense_bias[:] = 0
    assert {x["lang_pred"] for x in predict(frame, net).collect()} == {min(net.languages)}
