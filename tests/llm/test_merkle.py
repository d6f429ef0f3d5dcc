"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuegrid.llm.merkle import folded, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests, i, fanout=3):
    """(root, siblings in order, fold) of place i."""
    proof, steps = [], []
    while len(digests) > 1:
        runs = [digests[k : k + fanout] for k in range(0, len(digests), fanout)]
        run, j = runs[i // fanout], i % fanout
        proof += run[:j] + run[j + 1 :]
        steps.append((run[:j], run[j + 1 :]))
        digests, i = [h(*r) for r in runs], i // fanout

    def fold(d):
        for left, right in steps:
            d = h(*left, d, *right)
        return d

    return digests[0], proof, fold


def plain(rows):
    def less_newlines(r):
        return (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in by[s]], 0)[0] for s in sources]
    out = []
    for k, s in enumerate(sources):
        root, above, over = climb(subroots, k)
        for i, r in enumerate(by[s]):
            sub, proof, fold = climb([leaf(x) for x in by[s]], i)
            got = over(fold(leaf(less_newlines(r))))
            out.append((r[0], leaf(r), sub, root, h(*proof, *above), got, got == root))
    return sorted(map(str, out))


def documents(seed, n):
    r = random.Random(seed)
    ids = [*range(n // 2), *(r.randrange(-(1 << 62), 1 << 62) for _ in range(n // 2)), 5, 5, 5, None, None]
    texts = ["", "a\nb", "é \n", None, "x" * 100_000, "plain"]
    rows = [(i, r.choice(["a", "a", "a", "é", "Z", None, ""]), r.choice(["en", None]), r.choice([3, None]), r.choice(texts)) for i in ids]
    return rows + rows[:20] + [(1, "alone", None, None, "t")]


def table(spark, rows, extra=()):
    schema = "doc_id long, source string, lang string, n_chars long, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([r + ("x",) * len(extra) for r in rows], schema)


@pytest.mark.parametrize(("n", "levels", "cell"), [(60, 8, 4096), (400, 2, 4), (200, 1, 1)])
def test_query_form_equals_plain_trees(spark, n, levels, cell):
    rows = documents(n, n)
    docs = table(spark, rows, ["rank", "leaf", "group", "r", "_row", "path"])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = manifest(docs, FIELDS, [*FIELDS[:4], changed], levels=levels, cell=cell)
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("path", ".;", ""), 256), folded(F.col("received"), F.col("path")).alias("f"), (F.col("f") == F.col("root")))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def test_ids_of_any_shape_keep_their_order(spark):
    rows = [(i, "s", None, None, "") for i in (-(1 << 63), -1, 0, 1, (1 << 63) - 1, 4095, 4096)]
    got = manifest(table(spark, rows), FIELDS, cell=1).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows) and [r["rank"] for r in got] == list(range(7))


def test_no_rows_and_one_row(spark):
    assert manifest(table(spark, []), FIELDS).count() == 0
    row = (3, None, None, None, None)
    only = manifest(table(spark, [row]), FIELDS).first()
    assert only["root"] == only["subroot"] == only["leaf"] == leaf(row) and only["path"] == ""


def test_query(spark, tmp_path):
    from cuegrid.llm.queries import op13_radix_trie_manifest

    rows = documents(1, 80)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(tuple(r)) for r in op13_radix_trie_manifest(spark, str(tmp_path)).collect()) == plain(rows)
