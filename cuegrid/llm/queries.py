"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .conversation_repair import Repair, damaged, digests
from .embedding_dedup import linked_vectors
from .langid import fit, fold, predict
from .lm_scoring import score_texts
from .merkle import folded, manifest
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack
from .quality import assess, corpus_bands, within_corpus
from .secrets import BASE, KINDS, find_secrets, spelled
from .sharding import minimax_shards
from .substring_index import remove_repeats
from .token_rollup import corpus_rollup


WORD = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_inner_product(x, x)) AS l FROM v), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0 WHERE list_inner_product(a.x, b.x) / (a.l * b.l) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id"""

OP2 = f"""WITH d AS (SELECT doc_id, {WORD} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h), x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h) WHERE doc_id > first),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM x GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda t, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""

OP3 = f"""WITH d AS (SELECT doc_id, source, len({WORD}) AS size, ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~'))[1:15])::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, source_size * 3::DOUBLE AS cap, (sum(source_size) OVER () - coalesce(sum(source_size * 3::DOUBLE) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM s),
lv AS (SELECT arg_min(here, {{'r': source_size / w, 's': source}}) AS level FROM o WHERE cap > here * w),
t AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE level * w END AS target, ceil(n / 4096::DOUBLE)::BIGINT AS buckets FROM o, lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
j AS (SELECT d.*, r.source_size, r.target, floor(rate) AS whole, rate - floor(rate) AS part, u % buckets AS bucket FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, floor(part * sum(size) OVER (PARTITION BY source, bucket) + ('0x' || md5('18:' || coalesce(source, '~') || ':' || bucket)[1:15])::BIGINT / (1::BIGINT << 60)::DOUBLE)
  - coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM j)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(room, size)))::BIGINT AS taken FROM q"""

def _crc_steps() -> str:
    """The CRC-32 of every byte, from the rule of its polynomial, as a SQL list."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return f"{out}::BIGINT[]"


#: Binary search of the capacity, one step of one walk a row: 24 jumps over the prefix sums, then the next capacity.
OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(sha256(text), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, ({_crc_steps()})[xor(a & 255, b) + 1]))) AS crc FROM d),
g AS (SELECT key, min(doc_id) AS first, sum(size) AS bytes FROM d GROUP BY key), p AS (SELECT key, first, sum(bytes) OVER (ORDER BY first, key)::BIGINT AS v FROM g),
l AS (SELECT list(v ORDER BY v) AS vs, max(v) AS total FROM p), m AS (SELECT max(bytes)::BIGINT AS largest FROM g),
b(lo, hi, cap, pos, k) AS (SELECT greatest(-(-total // 24), largest), least(total, -(-total // 24) + largest), NULL::BIGINT, 0::BIGINT, 0 FROM l, m UNION ALL
  SELECT CASE WHEN k = 24 AND pos < total THEN cap + 1 ELSE lo END, CASE WHEN k = 24 AND pos >= total THEN cap ELSE hi END, CASE WHEN k BETWEEN 1 AND 23 THEN cap WHEN k = 0 THEN (lo + hi) // 2 END,
    CASE WHEN k = 24 THEN 0 ELSE coalesce(list_max(list_filter(vs, lambda x: x <= pos + CASE WHEN k = 0 THEN (lo + hi) // 2 ELSE cap END)), 0) END, CASE WHEN k = 24 THEN 0 ELSE k + 1 END FROM b, l WHERE lo < hi OR k > 0),
best AS (SELECT min(hi) AS cap FROM b WHERE k = 0 AND lo = hi), w(k, pos) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, coalesce(list_max(list_filter(vs, lambda x: x <= pos + best.cap)), 0) FROM w, l, best WHERE k < 24),
cuts AS (SELECT DISTINCT pos FROM w WHERE k > 0 AND pos < (SELECT max(pos) FROM w)), r AS (SELECT c.*, sum(size) OVER o AS e, row_number() OVER o AS rn FROM c JOIN p USING (key) WINDOW o AS (ORDER BY p.first, key, doc_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, (SELECT count(*) FROM cuts WHERE pos < e)::INT AS shard FROM r)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, rn - min(rn) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""


def _op11() -> str:
    """The same edits by a forward recursion over rows: for each conversation and state the cheapest, then least, edits so far."""
    new = lambda s, cost, letter, row: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {f'list_append({s}.r, {row})' if row else f'{s}.r'}}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    when = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE far END"
    short = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    keep = lambda s, i: when(f"stays AND i = '{i}'", new(s, short, "K", "role || ':' || text"))
    rerole = lambda s, role: when("stays", new(s, f"3 + {short}", "R", f"'{role}:' || text"))
    gone = lambda s: new(s, 4, "D", None)
    to_user = [f(s) for s in ("q0", "q1", "q3") for f in (lambda s: keep(s, "u"), lambda s: rerole(s, "user"))]
    user = least("n2", *(new(s, 3, "I", "'user:'") for s in ("n0", "n1", "n3")))
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, ({_crc_steps()})[xor(a & 255, b) + 1])))"
    far, none = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}", "{'c': 0, 'a': '', 'r': []::VARCHAR[]}"
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM c), e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM e),
f AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN {blank} THEN 'blank' WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS two FROM o),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
d(conv_id, n, q0, q1, q2, q3) AS (SELECT DISTINCT conv_id, 0::BIGINT, {none}, {far}, {{'c': 3, 'a': 'I', 'r': ['user:']}}, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} FROM f UNION ALL
  SELECT conv_id, n, n0, n1, n2, {least("n3", new("n2", 3, "I", "'assistant:'"))} FROM (SELECT conv_id, n, n0, n1, {user} AS n2, n3 FROM (
    SELECT conv_id, n, {gone("q0")} AS n0, {least(gone("q1"), keep("q0", "s"))} AS n1, {least(gone("q2"), *to_user)} AS n2, {least(gone("q3"), keep("q2", "a"), rerole("q2", "assistant"))} AS n3
    FROM (SELECT d.*  EXCLUDE (n), f.n, f.role, f.text, f.i, f.fault, coalesce(f.fault, '') NOT IN ('blank', 'duplicate') AS stays, {far} AS far FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n + 1)))),
b AS (SELECT conv_id, list_min([q0, q3]) AS q FROM d QUALIFY n = max(n) OVER (PARTITION BY conv_id))
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(q.c, 0)::BIGINT AS cost, coalesce(q.a, '') AS audit, sha256(coalesce(array_to_string(q.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM v.conv_id"""


def _op13() -> str:
    field = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    h = "hex(encode(coalesce(doc_id::VARCHAR, '')))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, ({_crc_steps()})[xor(a & 255, b) + 1])))"
    up = "list_transform(range(0, (len(ls) + 2) // 3), lambda i: sha256(array_to_string(ls[3 * i + 1:3 * i + 3], '')))"
    step = lambda names, n: f"SELECT {names}, lvl + 1, r // 3, sha256(array_to_string(ls[r - r % 3 + 1:r], '') || digest || array_to_string(ls[r + 2:r - r % 3 + 3], '')), proof || array_to_string(ls[r - r % 3 + 1:r], '') || array_to_string(ls[r + 2:r - r % 3 + 3], '') FROM {n} WHERE len(ls) > 1"
    return f"""WITH RECURSIVE x AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field('changed')}) AS received FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r0, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
t(s, lvl, ls) AS (SELECT s, 0, list(leaf ORDER BY r0) FROM p GROUP BY s UNION ALL SELECT s, lvl + 1, {up} FROM t WHERE len(ls) > 1),
u(lvl, ls) AS (SELECT 0, list(ls[1] ORDER BY s) FROM t WHERE len(ls) = 1 UNION ALL SELECT lvl + 1, {up} FROM u WHERE len(ls) > 1),
w(s, r0, lvl, r, digest, proof) AS (SELECT s, r0, 0, r0, received, '' FROM p UNION ALL {step('s, r0', '(SELECT w.*, t.ls FROM w JOIN t USING (s, lvl))')}),
i AS (SELECT w.* FROM w JOIN t USING (s, lvl) WHERE len(ls) = 1),
y(s, r0, lvl, r, digest, proof) AS (SELECT s, r0, 0, s, digest, proof FROM i UNION ALL {step('s, r0', '(SELECT y.*, u.ls FROM y JOIN u USING (lvl))')}),
o AS (SELECT y.* FROM y JOIN u USING (lvl) WHERE len(ls) = 1)
SELECT doc_id, leaf, sub.ls[1] AS subroot, top.ls[1] AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = top.ls[1] AS verified
FROM p JOIN o USING (s, r0) JOIN (SELECT * FROM t WHERE len(ls) = 1) sub USING (s) CROSS JOIN (SELECT * FROM u WHERE len(ls) = 1) top"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = minimax_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return predict(docs, fit(docs)).select("doc_id", held_out, "lang_pred", "score")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = [tokenizer_file(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")]
    return corpus_rollup(table(spark, sf_dir, "documents"), vocabularies).totals()


def op7_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_fertility_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    figures = Workspace(spark, "quality").save(assess(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id", "lang"]), "figures")
    judged = within_corpus(figures, corpus_bands(figures))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "byte_tokens", "entropy", "script")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(rows))
    hashes = digests(repair.repaired())
    found = repair.report().join(hashes, "start", "left")
    found = found.withColumn("_id", F.col("conv_id")).drop("conv_id", "start")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end=50256)


def op13_radix_trie_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    damaged_text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    head = ["doc_id", "source", "lang", "n_chars"]
    found = manifest(docs, [*head, "text"], [*head, damaged_text])
    found = found.withColumn("folded_root", folded(F.col("received"), F.col("path")))
    proof = F.sha2(F.translate("path", ".;", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_spherical_caps, op2_fingerprint_log, op3_source_mixing, op4_minimax_sharding, op5_byte_network, op6_token_rollup, op7_linear_grouping_packing, op8_bbit_minhash, op9_fertility_quality, op10_secret_scan, op11_conversation_repair, op12_attention_scores, op13_radix_trie_manifest)}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can give the rows; the others are held against plain versions in tests."""
    return {"op1_spherical_caps": OP1, "op2_fingerprint_log": OP2, "op3_source_mixing": OP3, "op4_minimax_sharding": OP4, "op8_bbit_minhash": OP8, "op11_conversation_repair": _op11(), "op13_radix_trie_manifest": _op13()}
