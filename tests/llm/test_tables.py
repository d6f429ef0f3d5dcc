"""Mixing, sharding and packing against plain versions."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from cuegrid.llm.mixing import mix_sources, repeated
from cuegrid.llm.packing import Plan, byte_encoder, pack, pieces_of
from cuegrid.llm.queries import tokenizer_file
from cuegrid.llm.sharding import minimax_shards

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _source string"


def corpus(n=300, seed=3):
    r = random.Random(seed)
    vocabulary = ["the", "Ofé", "thing", "x", "1234", "straße", "###", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(vocabulary, k=r.choice([0, 1, 5, 40, 400])))
        source = r.choice(["a"] * 6 + ["b", "c", "Z", "é", None])
        rows.append((i, text, "en", source, len(text), 7, "clash"))
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "en", "tiny", 0, 0, "")]
    rows += [(n + 2 + i, rows[5][1] or "same", "en", "a", 0, 0, "") for i in range(60)]
    rows += [(n + 2, "a repeated row", "en", "b", 0, 0, "")] * 3
    rows.append((n + 100, "very long " * 60_000, "en", "long", 0, 0, ""))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_mixing_hits_targets(docs):
    rows = mix_sources(docs, keep=["doc_id", "source", "text"]).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r["_size"] == len(brute.words(r["text"]))
        assert 0 <= r["_taken"] <= 3 * r["_size"]
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(r["_size"] for r in by[s]) for s in names]
    targets = brute.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, size, target in zip(names, sizes, targets):
        assert {r["_source_size"] for r in by[s]} == {size}
        assert abs(by[s][0]["_target"] - target) <= 1e-6 * max(1, target)
        assert abs(sum(r["_taken"] for r in by[s]) - target) <= 1
    assert abs(sum(targets) - sum(sizes)) < 1e-3


def test_mixing_is_repeatable_and_repeats_rows(docs):
    key = lambda d: sorted((r["doc_id"], r["_taken"]) for r in mix_sources(d).collect())
    assert key(docs) == key(docs.repartition(2))
    mixed = mix_sources(docs, keep=["doc_id", "text", "n_chars"])
    taken = sum(r["_taken"] for r in mixed.collect())
    assert sum(len(brute.words(r["text"])) for r in repeated(mixed, ["doc_id", "text", "n_chars"]).collect()) == taken


def test_sharding_is_minimax(docs):
    rows = minimax_shards(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) == len(texts)
    groups, first = defaultdict(int), {}
    for d, t in texts:
        groups[t] += len((t or "").encode()) + 8
        first[t] = min(d, first.get(t, d))
    ordered = sorted(groups, key=lambda t: first[t])
    load, slots, home = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        home[r["text_crc32"]].add(r["shard"])
    assert max(load.values()) == brute.minimax([groups[t] for t in ordered], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in home.values())
    assert set(load) <= set(range(24))


def test_sharding_small_groups_large_numbers(spark):
    r = random.Random(8)
    rows = [(i, "x" * r.randint(0, 30), None, None, 0, 0, "") for i in range(4000)]
    rows = [(i, f"{i} {t}", *rest) for i, t, *rest in rows]
    out = minimax_shards(spark.createDataFrame(rows, SCHEMA)).collect()
    load = defaultdict(int)
    for x in out:
        load[x["shard"]] += x["size"]
    assert max(load.values()) == brute.minimax([len(t) + 8 for _, t, *_ in rows], 24)


def test_packing_round_trip(docs):
    path = tokenizer_file("byte_bpe_50k.json")
    encode = byte_encoder(path)
    rows = pack(docs, path, with_ids=True).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*encode(r["text"] or "").tolist(), 2]
        for k, (s, n) in enumerate(pieces_of(len(ids), 1024)):
            want[(r["doc_id"], k, s, tuple(ids[s : s + n]))] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], tuple(r["ids"]))] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    tokens = sum(r["length"] for r in rows)
    assert len(places) <= 1.05 * -(-tokens // 1024) + 1


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain, encode, r = Tokenizer.from_file(path), byte_encoder(path), random.Random(1)
    letters = "abcé ñß\n\t 012's<|#$\xa0  –“”…̈日本語\x85\x1c 😀ǅ٣" + " " * 9
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randint(0, 40)))
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    text = "a <|endoftext|> b"
    assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizers_on_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain, encode, r = Tokenizer.from_file(path), byte_encoder(path), random.Random(3)
    texts = ["x" * 20_000, "ab" * 5000, "1234567890" * 800, " " * 3000 + "end", "\n\n\n" * 700, "https://example.org/" + "a1-_/%" * 900, "don't won't I'LL they've " * 200]
    for lo, hi in ((0x370, 0x3FF), (0x400, 0x4FF), (0x5D0, 0x5EA), (0x620, 0x64A), (0x900, 0x97F), (0xE00, 0xE5B), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F600, 0x1F64F)):
        texts.append(" ".join("".join(chr(r.randint(lo, hi)) for _ in range(r.randint(1, 9))) + r.choice(["", ",", ".", " word", " 12"]) for _ in range(300)))
    folder = "/root/testdata/sf0.01/documents.parquet"
    if os.path.exists(folder):
        texts += [t for t in pq.read_table(folder, columns=["text"]).column(0).to_pylist() if t][:300]
    for t in texts:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_rank_once(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(1024, r.exponential([30, 200, 700, 2000][seed], 3000).astype(int) + 1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = Plan(histogram, 1024, groups=[8, 64, 1024, 1024][seed])
    seen, places = defaultdict(int), defaultdict(list)
    for n, lo, hi, s, per, at in plan.rows:
        assert lo == seen[n]
        seen[n] = hi
        for k in range(hi - lo):
            places[s + k // per].append((at + k % per * n, n))
    assert dict(seen) == histogram and len(places) == plan.sequences
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).count() == 0
    assert minimax_shards(empty).count() == 0
    assert pack(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0
