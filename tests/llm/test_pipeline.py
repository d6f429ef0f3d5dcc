"""Token rollups and the whole pipeline against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cuegrid.llm import token_rollup
from cuegrid.llm.mixing import repeated
from cuegrid.llm.packing import byte_encoder, pieces_of
from cuegrid.llm.queries import tokenizer_file
from cuegrid.llm.secrets import redact, scan
from cuegrid.llm.token_rollup import EVENT, TokenRollup, corpus_rollup, counter, tidy

from . import brute
from .test_rows import plain_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _size int, n_words double"


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "times", "straße", "wisdom", "foolishness", "épôque", "belief", "season", "light"]
    stems = "water house river garden winter summer letter number people mother father silver market corner island".split()
    vocabulary += [a + b for a in stems for b in stems]
    rows = []
    for i in range(120):
        text = " ".join(r.choices(vocabulary, k=r.choice([5, 30, 80, 900])))
        if r.random() < 0.2:
            text += ' password = "hunter2hunter2" \n\n\n\nend  '
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), len(text), "clash", 1, 0.5))
    rows += [(200 + i, rows[k][1].upper() if i % 2 else rows[k][1], "en", "b", 1, "", 1, 0.5) for i, k in enumerate(r.choices(range(120), k=30))]
    rows += [(300, None, None, None, None, None, None, None), (301, "", "en", "a", 0, "", 0, 0.0), rows[4], rows[4]]
    rows += [(None, rows[9][1], "en", "c", 0, "", 0, 0.0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


def test_rollup_over_a_corpus(docs):
    files = [tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_multi_50k.tiktoken")]
    rollup = corpus_rollup(docs, files)
    least = {}
    for r in docs.collect():
        if r["doc_id"] is not None and r["text"] is not None:
            least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    want, revised = Counter(), set()
    for r in docs.collect():
        if r["doc_id"] is not None and r["text"] is not None and r["doc_id"] > least[r["text"]]:
            continue
        for f, version in zip(files, ("byte_bpe_50k", "byte_bpe_multi_50k")):
            text = r["text"] or ""
            if r["doc_id"] is not None:
                text = tidy(text)
                if text != (r["text"] or ""):  # repeated rows of one document are revised to one
                    if (r["doc_id"], version) in revised:
                        continue
                    revised.add((r["doc_id"], version))
            want[(r["source"], r["lang"], version, "docs")] += 1
            want[(r["source"], r["lang"], version, "tokens")] += counter(f)(text)
    got = Counter()
    for r in rollup.totals().collect():
        got[(r["source"], r["lang"], r["version"], "docs")] = r["n_docs"]
        got[(r["source"], r["lang"], r["version"], "tokens")] = r["n_tokens"]
    assert got == want  # a row without id keeps its first count
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(map(tuple, rollup.recount().collect()), key=str)


def test_batches_are_idempotent(spark):
    events = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    a = TokenRollup(spark)
    first = events((1, "insert", "s", "en", "v1", 10), (1, "insert", "s", "en", "v1", 5), (2, "insert", None, "en", "v1", 7), (3, "insert", "s", "en", "v2", None))
    assert a.commit("b1", first) and not a.commit("b1", first)
    second = events((1, "revise", "t", "en", "v1", 4), (2, "delete", None, "en", "v1", None), (9, "delete", "s", "en", "v1", 3))
    assert a.commit("b2", second)
    want = {("t", "en", "v1", 1, 4), ("s", "en", "v2", 1, 0)}
    assert {tuple(r) for r in a.totals().collect()} == want
    again = TokenRollup(spark, a.ws.root)
    assert again.batches() == ["b1", "b2"] and not again.commit("b2", second)
    assert {tuple(r) for r in again.totals().collect()} == want
    # a batch that broke off before its entry does not count
    a._write(first.select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), "n_tokens"), "broken")
    assert {tuple(r) for r in again.totals().collect()} == want and again.commit("b3", first)
    with pytest.raises(ValueError):
        a.commit("../x", first)


def test_revision_in_a_new_session(spark):
    events = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    root = TokenRollup(spark).ws.root
    TokenRollup(spark, root).commit("load", events((1, "insert", "s", "en", "v", 10), (None, "insert", "s", "en", "v", 3)))
    other = TokenRollup(spark, root)
    other.commit("new", events((1, "revise", "s", "en", "v", 4), (None, "revise", "s", "en", "v", 9), (None, "delete", "s", "en", "v", None)))
    for r in (other, TokenRollup(spark, root)):
        assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 2, 7)]
    # of two revisions in a batch the larger holds, beside a deletion as well
    other.commit("two", events((1, "revise", "s", "en", "v", 4), (1, "revise", "s", "en", "v", 5), (1, "delete", "s", "en", "v", None)))
    assert [tuple(x) for x in other.totals().collect()] == [("s", "en", "v", 2, 8)]


def test_a_second_writer_works_its_batch_out_again(spark):
    events = lambda *rows: spark.createDataFrame(list(rows), EVENT)

    class Late(TokenRollup):
        def _enter(self, number, entry):
            if self.log()[0] == 1:
                assert TokenRollup(self.spark, self.ws.root).commit("between", events((1, "revise", "t", "en", "v", 6)))
            return super()._enter(number, entry)

    late = Late(spark)
    late.ws.create_text("log/00000000", '{"batch": null, "attempt": "none", "before": [], "replaced": []}')
    late._write(events().selectExpr("doc_id", "source", "lang", "version", "1L n_docs", "n_tokens"), "none")
    assert late.commit("late", events((1, "revise", "s", "en", "v", 4)))
    assert late.batches() == ["between", "late"]
    assert [tuple(x) for x in late.totals().collect()] == [("s", "en", "v", 1, 4)] == [tuple(x) for x in late.recount().collect()]


def test_ranges_of_ids(spark):
    ids = [None, 1, 2, 3, 500, 501, 10**15, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for most in (1, 2, 64):
        spans = token_rollup.id_ranges(rows, most)
        assert len(spans) <= most and all(any(a <= i <= b for a, b in spans) for i in ids if i is not None)
    near = rows.where("doc_id between 1 and 600")
    assert token_rollup.id_ranges(near, 2) == [(1, 3), (500, 501)] and token_rollup.id_ranges(rows.where("false")) == []


def test_a_small_commit_reads_a_small_part(spark):
    """A thousand neighbours of a million documents: rows that the scan gives, after the least and greatest ids of pages."""
    rollup, many = TokenRollup(spark), 1_000_000
    row = lambda op: [F.col("id").alias("doc_id"), F.lit(op).alias("op"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("v").alias("version"), (F.col("id") % 7).alias("n_tokens")]
    rollup.commit("load", spark.range(many).select(*row("insert")))
    aimed = spark.range(400_000, 401_000).select(F.col("id").alias("doc_id"), F.lit("v").alias("version"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = rollup._held(rollup.log()[1], aimed)
        assert held.count() == 1000
        held.collect()
        leaves = held._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        read = [s.metrics().apply("numOutputRows").value() for s in scans if "FileScan" in s.toString() or "Scan parquet" in s.toString()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read and sum(read) < many / 10
    before = sum(r["n_tokens"] for r in rollup.totals().collect())
    assert rollup.commit("less", spark.range(400_000, 401_000).select(*row("delete")))
    assert sum(r["n_tokens"] for r in rollup.totals().collect()) == before - sum(k % 7 for k in range(400_000, 401_000))
    assert rollup.sum_up() and rollup.vacuum() == 2 and rollup.batches() == ["load", "less"]
    assert sorted(map(tuple, rollup.totals().collect())) == sorted(map(tuple, rollup.recount().collect()))


def test_many_batches_are_summed_up(spark, monkeypatch):
    monkeypatch.setattr(token_rollup, "MOST_BATCHES", 3)
    r, held, rollup = random.Random(12), {}, TokenRollup(spark)
    for k in range(8):
        rows = []
        for d in r.sample(range(30), 12):
            op, n = r.choice(["insert", "revise", "delete"]), r.randint(0, 50)
            rows.append((d, op, r.choice(["a", None]), "en", "v", n))
            if op != "insert":
                held[d] = []
            if op != "delete":
                held.setdefault(d, []).append((rows[-1][2], n))
        assert rollup.commit(f"b{k}", spark.createDataFrame(rows, EVENT))
        docs, tokens = Counter(), Counter()
        for source, n in (x for xs in held.values() for x in xs):
            docs[source] += 1
            tokens[source] += n
        got = {(x["source"]): (x["n_docs"], x["n_tokens"]) for x in rollup.totals().collect()}
        assert got == {s: (docs[s], tokens[s]) for s in docs}
        assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(map(tuple, rollup.recount().collect()), key=str)
    size, log = rollup.log()
    assert size == 10 and [e["batch"] for e in log] == [None] and rollup.batches() == [f"b{k}" for k in range(8)]


def test_stages_one_by_one(spark, docs):
    key = lambda d: Counter(tuple(r) for r in d.collect())
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, "")
    assert good.columns == docs.columns
    rows = docs.collect()
    kept = key(good)
    for r in rows:
        if plain_quality(r["text"])[5]:
            assert tuple(r) not in kept
    assert kept == Counter(tuple(r) for r in rows if not plain_quality(r["text"])[5])
    unique = stage["near_dedup"](spark, docs, "")
    distinct = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    want = {d for d, (_, c) in brute.near_components(list(distinct.items()), 80).items() if c == d}
    got = [r["doc_id"] for r in unique.collect()]
    assert Counter(got) == Counter([*want, None])
    safe = {(r["doc_id"], r["source"]): r for r in stage["secret_scan"](spark, docs, "").collect()}
    for r in rows:
        clean = safe[(r["doc_id"], r["source"])]
        if r["text"] is None:
            assert clean["text"] is None
        else:
            assert clean["text"] == redact(r["text"], scan(r["text"]), "[SECRET]")
            assert clean["n_chars"] == (len(clean["text"]) if clean["text"] != r["text"] else r["n_chars"])
    mixed = stage["source_mix"](spark, docs, "")
    assert mixed.columns == docs.columns
    total = sum(len(brute.words(r["text"])) for r in rows)
    assert abs(sum(len(brute.words(r["text"])) for r in mixed.collect()) - total) <= 4


def test_one_of_two_texts_with_an_id_goes(spark):
    copied, own = " ".join(f"copied{i}" for i in range(40)), " ".join(f"own{i}" for i in range(40))
    rows = [(1, copied), (5, copied.upper().replace(" ", "  ")), (5, own), (5, own), (6, "x y z"), (7, None), (7, ""), (8, own)]
    frame = spark.createDataFrame([(i, t, "en", "a", 0, "", 0, 0.0) for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "").collect())
    assert got == Counter([(1, copied), (5, own), (6, "x y z"), (7, None), (7, "")])
    twice = spark.createDataFrame([(1, own, "en", s, 0, "", 0, 0.0) for s in ("b", "a", None)], SCHEMA)
    assert [r["source"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, twice, "").collect()] == [None]


def test_extra_columns_of_any_name_stay_as_they_are(spark):
    about = ["river", "market", "winter", "garden"]
    own = [f"The {x} was quiet when the old man walked home with two bags of bread, and nobody in the {x} could say why he had come back so late that year." for x in about]
    rows = [(i % 3, own[i], "en", "a", len(own[i]), 7 + i, f"x{i}", i, f"k{i}", 0.5 * i) for i in range(4)] + [(0, own[0], "en", "b", len(own[0]), 99, "y", 9, "z", 0.0)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "_first", "_digest", "count", "text_key", "a.b"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _first long, _digest string, count long, text_key string, `a.b` double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == names and out.dtypes == frame.dtypes, name
        extra = Counter(tuple(r)[5:] for r in out.collect())
        assert set(extra) <= {r[5:] for r in rows} and extra, name
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, frame, "").count() >= 5


def test_very_long_texts_pass_every_stage(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(3000)]
    long = " ".join(r.choices(vocabulary, k=150_000)) + "."
    rows = [(1, long, "en", "a", len(long), "", 0, 0.0), (2, long.replace("a", "A", 3), "en", "a", len(long), "", 0, 0.0), (3, long[: len(long) // 2], "en", "b", 0, "", 0, 0.0), (4, long + " password=abcd1234efgh", "fr", "b", 0, "", 0, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    assert {x["doc_id"] for x in stage["near_dedup"](spark, frame, "").collect()} == {1, 3}
    assert {x["doc_id"]: "[SECRET]" in x["text"] for x in stage["secret_scan"](spark, frame, "").collect()} == {1: False, 2: False, 3: False, 4: True}
    sizes = sum(len(brute.words(x[1])) for x in rows)
    assert abs(sum(len(brute.words(x["text"])) for x in stage["source_mix"](spark, frame, "").collect()) - sizes) <= 4
    ids = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).encode(rows[0][1], add_special_tokens=False).ids
    pieces = sorted((x["piece"], x["start"], list(x["ids"])) for x in stage["best_fit_packing"](spark, frame, "").where("doc_id = 1").collect())
    assert [i for _, _, p in pieces for i in p] == [*ids, 2]
    assert {x["doc_id"] for x in stage["quality_rules"](spark, frame, "").collect()} <= {1, 2, 3, 4}


def test_run_end_to_end(spark, docs, tmp_path):
    """Every token of the result, against the texts that the stages before the last one leave."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rest = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rest = spark.createDataFrame(stage(spark, rest, str(tmp_path)).collect(), SCHEMA)
    plain, want = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), Counter()
    for r in rest.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.update((r["doc_id"], k, s, tuple(ids[s : s + n])) for k, (s, n) in enumerate(pieces_of(len(ids), 1024)))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == want and out
    places = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty_corpus(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert corpus_rollup(empty, [tokenizer_file("byte_bpe_50k.json")]).totals().count() == 0
    assert repeated(spark.sql("select 'a b' text, 0L _whole, 1L _extra, 2L _size"), ["text"]).first()["text"] == "a"
    assert pieces_of(5, 4) == [(0, 1), (1, 4)] and len(byte_encoder(tokenizer_file("byte_bpe_50k.json"))("ab")) == 1
