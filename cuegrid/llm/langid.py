"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, each
filter keeps its greatest response in the window, and a softmax layer decides. The network
is trained with numpy on a bounded sample of labelled text. A text is cut into windows that
cover all of it; the mean of their log-probabilities is the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks
from .textscan import buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 12, 8
#: Windows overlap by this much, so that no filter position is lost at a cut.
OVERLAP = max(WIDTHS) - 1
#: Labelled texts per language that training looks at, chosen by a hash of doc_id; one window of each.
SAMPLE_PER_LANG = 1500
UNDETERMINED = "und"


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads and stays zero
    filters: list[np.ndarray]  # per width: width x EMBED x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    dense: np.ndarray
    dense_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Per width the responses of byte pairs (and of a last single byte), as lookup tables."""
        out = []
        for f in self.filters:
            one = [(self.embed @ f[i]).astype(np.float32) for i in range(len(f))]
            pairs = [(one[i][None, :, :] + one[i + 1][:, None, :]).reshape(1 << 16, -1) for i in range(0, len(f) - 1, 2)]
            out.append(pairs + [one[-1]] * (len(f) % 2))
        return out


def _tree_max(x: np.ndarray) -> np.ndarray:
    """Greatest over axis 1, by halves."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        top = np.maximum(x[:, :half], x[:, half : 2 * half])
        if x.shape[1] % 2:
            top[:, 0] = np.maximum(top[:, 0], x[:, -1])
        x = top
    return x[:, 0]


def pooled(windows: np.ndarray, tables: list[list[np.ndarray]], step: int = 128) -> np.ndarray:
    """Greatest response of every filter in each window (windows x WINDOW bytes)."""
    out = np.empty((len(windows), len(tables) * FILTERS), np.float32)
    for lo in range(0, len(windows), step):
        w = windows[lo : lo + step]
        code = w[:, :-1].astype(np.uint16) | (w[:, 1:].astype(np.uint16) << np.uint16(8))
        for k, parts in enumerate(tables):
            width = WIDTHS[k]
            n = w.shape[1] - width + 1
            got = parts[0][code[:, :n]]
            for p, table in enumerate(parts[1:], 1):
                index = code[:, 2 * p : 2 * p + n] if len(table) > 256 else w[:, 2 * p : 2 * p + n]
                got += table[index]
            out[lo : lo + step, k * FILTERS : (k + 1) * FILTERS] = _tree_max(got)
    return out


def log_probs(net: ByteNet, top: np.ndarray) -> np.ndarray:
    z = np.maximum(top + net.bias, 0) @ net.dense + net.dense_bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row): windows of WINDOW bytes that cover every non-empty row; the last is padded with zeros."""
    stride = WINDOW - OVERLAP
    lens = np.diff(bounds)
    n = np.where(lens > 0, np.maximum(1, -(-(lens - OVERLAP) // stride)), 0)
    row = np.repeat(np.arange(len(lens)), n)
    start = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride
    at = start[:, None] + np.arange(WINDOW)
    inside = at < bounds[1:][row][:, None]
    at[~inside] = 0
    return np.where(inside, data[at] if len(data) else 0, 0).astype(np.uint8), row


def train(texts: list[str], labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on the cross-entropy of single windows; deterministic for a given list."""
    r = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "replace")[:WINDOW], np.uint8)
        x[i, : len(raw)] = raw
    net = ByteNet(
        languages,
        r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        [r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    params = [net.embed, *net.filters, net.bias, net.dense, net.dense_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), batch):
            pick = order[lo : lo + batch]
            grads = _gradients(net, x[pick], y[pick], weight)
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * m / (np.sqrt(v) + 1e-8)
            net.embed[0] = 0
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    e = net.embed[x]  # batch x WINDOW x EMBED
    peaks, top = [], []
    for f in net.filters:
        w = len(f)
        n = x.shape[1] - w + 1
        seen = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
        got = seen @ f.reshape(w * EMBED, FILTERS)
        at = got.argmax(axis=1)  # batch x FILTERS
        peaks.append(at)
        top.append(np.take_along_axis(got, at[:, None, :], axis=1)[:, 0])
    pre = np.concatenate(top, axis=1) + net.bias
    hidden = np.maximum(pre, 0)
    z = hidden @ net.dense + net.dense_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight[y] / len(y))[:, None]
    dense, dense_bias = hidden.T @ p, p.sum(axis=0)
    back = (p @ net.dense.T) * (pre > 0)
    embed, filters = np.zeros_like(net.embed), []
    rows = np.arange(len(x))[:, None]
    for k, f in enumerate(net.filters):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]  # batch x FILTERS
        df = np.empty_like(f)
        for i in range(len(f)):
            byte = x[rows, peaks[k] + i]  # batch x FILTERS
            df[i] = np.einsum("bfe,bf->ef", net.embed[byte], g)
            np.add.at(embed, byte, g[:, :, None] * f[i].T[None])
        filters.append(df)
    return [embed, *filters, back.sum(axis=0), dense, dense_bias]


def fold(doc_id: Column) -> Column:
    """The remainder that decides what is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def labelled_sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """(lang, piece) of at most ``per_lang`` labelled texts per language outside the held-out fold.

    The first by hash within a language. Rows are thinned by hash to about twice the bound
    of their language while the table is read, before any exchange, and a piece is at most
    WINDOW characters, so neither a hot language nor a large table brings more to a task.
    Of a language with at most twice the bound every row stays.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    # one number per language: the network has an output for each of them anyway
    sizes = labelled.groupBy("lang").count().collect()
    share = {r["lang"]: 2.0 * per_lang / r["count"] for r in sizes if r["count"] > 2 * per_lang}
    thin = F.lit(True)
    if share:
        shares = F.create_map(*[F.lit(x) for item in share.items() for x in item])
        place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 31)) / F.lit(float(1 << 31))
        thin = place < F.coalesce(F.element_at(shares, F.col("lang")), F.lit(1.0))
    u = F.xxhash64("doc_id")
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    rows = labelled.where(thin).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", u.alias("_u"), F.substring("text", (F.pmod(u, room) + 1).cast("int"), F.lit(WINDOW)).alias("piece"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "piece"))
    return rows.withColumn("_n", first).where(F.col("_n") <= per_lang).select("lang", "piece", "_u")


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> ByteNet | None:
    """The network trained on the bounded sample; None without labelled text."""
    rows = sorted(labelled_sample(docs, per_lang).collect(), key=lambda r: (r["lang"], r["_u"], r["piece"]))
    return train([r["piece"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Null text or text without a letter, or no network: ``und`` with score 0. Of equally
    likely languages the first by code point. Very long text: all of its windows count. Repeated rows and null ids: each row by itself. Empty
    table: no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables()
        for part in chunks(batches):
            data, bounds = buffers(part.column(1))
            windows, row = cut(data, bounds)
            total = np.zeros((part.num_rows, len(net.languages)))
            for lo in range(0, len(row), 4096):
                np.add.at(total, row[lo : lo + 4096], log_probs(net, pooled(windows[lo : lo + 4096], tables)))
            mean = total / np.maximum(np.bincount(row, minlength=part.num_rows), 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([net.languages[b] for b in best], pa.string()), pa.array(p[np.arange(len(best)), best]), part.column(2)],
                ["doc_id", "lang_pred", "score", "letter"],
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    if net is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = docs.select("doc_id", "text", letter).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, letter boolean")
    return found.select("doc_id", F.when(F.col("letter"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
