"""SQL for the rows of further queries: folds as recursive tables, interval plans, text and files."""

from __future__ import annotations

from .functions.language import ONE_LINE, UNSPACED_LAYOUT, WIDE
from .functions.text import EXTRA_DROPPED, UNIT_SIGNS
from .sources.subtitles import ass_header

#: Where each point p of a table may go in the silences ``sil``.
SNAPPED = """near AS (SELECT p.track_id, p.seq, p.t, sil.s, sil.e, p.t BETWEEN sil.s AND sil.e AS inside, least(greatest((sil.s + sil.e) / 2, p.t - 1.5), p.t + 1.5) AS p
  FROM p JOIN sil ON p.track_id = sil.track_id AND sil.s <= p.t + 1.5 AND sil.e >= p.t - 1.5),
best AS (SELECT track_id, seq, bool_or(inside) AS inside, arg_min(p, {'d': abs(p - t), 's': s, 'e': e}) AS p FROM near WHERE inside OR p BETWEEN s AND e GROUP BY 1, 2),
snap AS (SELECT p.track_id, p.seq, CASE WHEN coalesce(inside, false) THEN p.t ELSE coalesce(best.p, p.t) END AS t FROM p LEFT JOIN best USING (track_id, seq))"""
#: Pieces of x that no span of y covers; both are tables of (track_id, s, e), y without overlaps.
LEFT_OVER = """{name}h AS (SELECT x.track_id, x.s, x.e, y.s AS ks, y.e AS ke FROM {x} x JOIN {y} y ON x.track_id = y.track_id AND least(x.e, y.e) > greatest(x.s, y.s)),
{name} AS (SELECT track_id, f AS s, ks AS e FROM (SELECT *, greatest(s, coalesce(max(ke) OVER (PARTITION BY track_id, s, e ORDER BY ks, ke ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS f FROM {name}h) WHERE ks > f
  UNION ALL SELECT x.track_id, greatest(x.s, coalesce(m, x.s)), x.e FROM {x} x LEFT JOIN (SELECT track_id, s, e, max(ke) AS m FROM {name}h GROUP BY 1, 2, 3) h ON h.track_id = x.track_id AND h.s = x.s AND h.e = x.e WHERE greatest(x.s, coalesce(m, x.s)) < x.e)"""
#: Inputs of the queries that show every branch: texts in other scripts, a detector's answers, languages of all policies.
SCRIPT_TEXTS = ("東京の空はとても青いですね", "今天天气很好我们去公园散步", "오늘은 날씨가 아주 좋아요 그렇죠")
LABELS = ("English, German", "zh", "ja; ko", "Korean|fr", "", "Klingon/pt-BR")
REPLIES = ('{"choice": 1}', '{"choice": 99}', '{"choice": 1.5}', '{"choice": 0, "breaks": [1]}', "", "the second one", '{"choice": "1"}')
POLICY_LANGS = ("en", "ja", "zh", "ko", "th", "yue", "fr")
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WIDTH = r"(length({t}) + length(regexp_replace({t}, '[\x00-\x7F\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')))"


def wide(t: str) -> str:
    return WIDTH.format(t=t)


def stuttered(t: str) -> str:
    """Equal neighbouring words of letters joined by hyphens; other white space stays."""
    word, end, start = "regexp_extract_all({t}, '[^ \\t\\n\\r\\f\\x0B]+')", "regexp_extract({w}, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Za-z]+)$', 1)", "regexp_extract({w}, '^([A-Za-z]+)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1)"
    w = word.format(t=t)
    same = f"lower({end.format(w='w[i]')}) <> '' AND lower({end.format(w='w[i]')}) = lower({start.format(w='w[i + 1]')})"
    gaps = f"regexp_extract_all(regexp_replace({t}, '^[ \\t\\n\\r\\f\\x0B]+', ''), '[ \\t\\n\\r\\f\\x0B]+')"
    return (
        f"regexp_extract({t}, '^[ \\t\\n\\r\\f\\x0B]*') || coalesce((SELECT string_agg(w[i] || CASE WHEN i = len(w) THEN coalesce(g[i], '') WHEN {same} THEN '-' ELSE g[i] END, '' ORDER BY i) FROM (SELECT {w} AS w, {gaps} AS g) q, range(1, len(w) + 1) AS r(i)), '')"
    )


def thousandth(x: str) -> str:
    """Rounded half to even as decimal text, to the thousandth."""
    d = f"({x}::VARCHAR::DECIMAL(34, 20) * 1000)"
    return f"(CASE WHEN {d} - floor({d}) > 0.5 THEN floor({d}) + 1 WHEN {d} - floor({d}) < 0.5 THEN floor({d}) ELSE floor({d}) + floor({d})::BIGINT % 2 END::DOUBLE / 1000)"


def wrapped(source: str, penalty: str, lines: int = 2) -> str:
    """Tables ending in wrapped (track_id, seq, text): texts of ``source`` (track_id, seq, lang, text) in spaced languages on two lines at most."""
    return f"""wu AS MATERIALIZED (SELECT track_id, seq, lang, text AS given, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS u FROM {source}),
wi AS (SELECT *, {wide("word")} + 1 AS c FROM (SELECT track_id, seq, lang, len(u) AS n, unnest(u) AS word, generate_subscripts(u, 1) AS i FROM wu)),
wt AS MATERIALIZED (SELECT *, sum(c) OVER (PARTITION BY track_id, seq ORDER BY i) - 1 AS a, sum(c) OVER (PARTITION BY track_id, seq) - 1 AS whole FROM wi),
ww AS (SELECT *, whole - a - 1 AS b FROM wt WHERE i < n),
wp AS (SELECT *, abs(a - b) + 100 * ({penalty.format(t="word", l="lang")}) + 30 * ((CASE WHEN i = 1 AND a <= 10 THEN 1 ELSE 0 END) + (CASE WHEN i = n - 1 AND b <= 10 THEN 1 ELSE 0 END)) + (CASE WHEN a > b THEN 1 ELSE 0 END) AS score FROM ww),
wb AS (SELECT track_id, seq, arg_min(i, {{'s': score, 'i': i}}) FILTER (a <= 42 AND b <= 42) AS fit, coalesce(max(i) FILTER (a <= ceil((a + b + 1) / {lines}::DOUBLE)), 1) AS over FROM wp GROUP BY 1, 2),
wrapped AS (SELECT wu.track_id, wu.seq, CASE WHEN len(u) = 0 THEN given WHEN len(u) = 1 OR wl.whole <= 42 THEN array_to_string(u, ' ')
  ELSE array_to_string(u[1:coalesce(fit, over)], ' ') || chr(10) || array_to_string(u[coalesce(fit, over) + 1:], ' ') END AS text FROM wu LEFT JOIN wb USING (track_id, seq) LEFT JOIN (SELECT track_id, seq, whole FROM wt WHERE i = 1) wl USING (track_id, seq))"""


def more() -> dict[str, str]:
    from . import queries as q

    recursive = lambda parts: "WITH RECURSIVE " + parts
    coalesced = q.COALESCED.format
    out: dict[str, str] = {}

    # ------------------------------------------------------------ languages
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    texts = lambda n: f"[text, {listed(SCRIPT_TEXTS)}][{n} % 4 + 1]"
    label = lambda n, lang: f"[{listed(LABELS)}, {lang}][{n} % {len(LABELS) + 1} + 1]"
    count = lambda p: f"length(regexp_replace(text, '[^{p}]', '', 'g'))"
    scripts = f"""sc AS (SELECT *, {count(chr(92) + 'p{Han}')} AS han, {count(chr(92) + 'p{Hiragana}' + chr(92) + 'p{Katakana}ー')} AS kana, {count(chr(92) + 'p{Hangul}')} AS hangul, {count(chr(92) + 'p{Latin}')} AS latin, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS total,
  len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*')) AS words FROM src),
sd AS (SELECT *, CASE WHEN hangul >= 4 AND hangul * 5 >= total * 3 THEN 'ko' WHEN kana >= 2 AND han + kana >= 4 AND (han + kana) * 5 >= total * 3 AND kana * 6 >= han + kana THEN 'ja'
  WHEN han >= 4 AND han * 5 >= total * 3 AND kana * 6 < han + kana THEN 'han' WHEN latin >= 12 AND words >= 4 AND latin * 5 >= total * 4 THEN 'latin' END AS script FROM sc)"""
    codes = "{" + ", ".join(f"'{k}': '{c}'" for c, n in q.lg.NAMES.items() for k in (c, n)) + "}"
    code = lambda x: f"(MAP {codes})[string_split(replace(lower(trim({x})), '_', '-'), '-')[1]]"
    effective = f"""lb0 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(detected, ''), '[,，;；|/]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM sd), lb1 AS (SELECT *, list_transform(l, lambda x: {code("x")}) AS c FROM lb0),
ef AS (SELECT *, CASE script WHEN 'han' THEN coalesce(list_filter(l, lambda x: {code("x")} IN ('zh', 'yue', 'ja'))[1], 'zh') WHEN 'ja' THEN coalesce(list_filter(l, lambda x: {code("x")} = 'ja')[1], 'ja') WHEN 'ko' THEN coalesce(list_filter(l, lambda x: {code("x")} = 'ko')[1], 'ko')
  WHEN 'latin' THEN coalesce(list_filter(l, lambda x: {code("x")} IN ({listed(q.lg.LATIN)}))[1], l[1]) ELSE l[1] END AS effective FROM lb1)"""
    out["a12_dominant_script"] = f"WITH src AS (SELECT doc_id, {texts('doc_id')} AS text FROM documents), {scripts} SELECT doc_id, script FROM sd"
    out["x27_reconcile_language"] = f"WITH src AS (SELECT doc_id, {texts('n')} AS text, {label('n', 'lang')} AS detected FROM (SELECT *, doc_id + doc_id // 4 AS n FROM documents)), {scripts}, {effective} SELECT doc_id, effective FROM ef"
    out["a1_vote_over_chunks"] = f"""WITH src AS (SELECT conv_id AS track_id, turn AS seq, {texts('turn')} AS text, {label('turn', "'en'")} AS detected FROM conversations), {scripts}, {effective},
v AS (SELECT track_id, coalesce({code("effective")}, lower(trim(effective))) AS lang, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS mass, min(seq) AS seq FROM ef WHERE effective IS NOT NULL AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 0 GROUP BY 1, 2),
r AS (SELECT track_id, arg_min(lang, {{'m': -mass, 's': seq}}) AS lang FROM v GROUP BY 1) SELECT t.track_id, coalesce(r.lang, 'english') AS lang FROM (SELECT DISTINCT track_id FROM src) t LEFT JOIN r USING (track_id)"""
    policy = f"(SELECT doc_id, [{listed(POLICY_LANGS)}][doc_id % {len(POLICY_LANGS)} + 1] AS lang FROM documents)"
    out["x12_layout_defaults"] = f"SELECT doc_id, CASE WHEN lang IN ('zh', 'yue', 'ja') THEN 1 ELSE 2 END AS max_lines, CASE WHEN lang IN ('zh', 'yue', 'ja') THEN 18 WHEN lang = 'ko' THEN 12 ELSE 42 END AS max_line_length, CASE WHEN lang IN ('zh', 'yue', 'ja') THEN 36 WHEN lang = 'ko' THEN 24 ELSE 42 END AS budget, lang NOT IN ('zh', 'yue', 'ja', 'th', 'lo', 'my') AS spaced FROM {policy}"
    out["p12_thresholds"] = f"SELECT doc_id, CASE WHEN lang = 'ja' THEN 560 ELSE 400 END AS clause_ms, 1000 AS skip_ms, CASE WHEN lang = 'ja' THEN 980 ELSE 700 END AS offline_ms, 0.5::DOUBLE AS min_cue_s, 7::DOUBLE AS max_cue_s, 0.3::DOUBLE AS glue_gap_s, CASE WHEN lang = 'ja' THEN 7 WHEN lang IN ('zh', 'yue', 'ko') THEN 9 ELSE 17 END::DOUBLE AS cps, 0.25::DOUBLE AS lag_out_s, 0.458::DOUBLE AS shot_snap_s FROM {policy}"

    # ------------------------------------------------------------ aggregates
    gaps = f"{q.WORDS}, g AS (SELECT track_id, CASE WHEN s > prev THEN (s - prev) * 1000 END AS gap_ms FROM (SELECT *, lag(e) OVER (PARTITION BY track_id ORDER BY seq) AS prev FROM words))"
    out["a4_rescaled_thresholds"] = f"""WITH {gaps}, ad AS (SELECT track_id, CASE WHEN count(gap_ms) FILTER (gap_ms < 2000) >= 50 THEN greatest(300, least(800, round_even(round(quantile_cont(gap_ms, 0.9) FILTER (gap_ms < 2000) * 1.15, 6), 0)))::INT END AS a FROM g GROUP BY track_id),
pol AS (SELECT DISTINCT track_id, CASE WHEN lang = 'ja' THEN 560 ELSE 400 END AS c, CASE WHEN lang = 'ja' THEN 980 ELSE 700 END AS o FROM words)
SELECT track_id, coalesce(a, c)::INT AS clause_ms, coalesce(round_even(a * (o / c), 0)::INT, o)::INT AS offline_ms FROM pol LEFT JOIN ad USING (track_id)"""
    out["a8_mid_phrase_cuts"] = f"""WITH {q.CUES}, ph AS (SELECT DISTINCT track_id, o FROM (SELECT track_id, seq, coalesce(sum(length(text)) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM words) WHERE seq % 3 = 0),
c AS (SELECT *, sum(length(regexp_replace(text, '[ \\n]', '', 'g'))) OVER (PARTITION BY track_id ORDER BY seq) AS o, lead(s) OVER (PARTITION BY track_id ORDER BY seq) - e AS gap FROM cues),
m AS (SELECT c.track_id, gap >= 0.7 AS paused, ph.o IS NULL AS mid FROM c LEFT JOIN ph ON ph.track_id = c.track_id AND ph.o = c.o WHERE gap IS NOT NULL),
n AS (SELECT track_id, count(*) FILTER (NOT paused) AS n_len, count(*) FILTER (paused) AS n_gap, count(*) FILTER (NOT paused AND mid) AS n_len_mid, count(*) FILTER (paused AND mid) AS n_gap_mid FROM m GROUP BY 1)
SELECT *, CASE WHEN n_len > 0 THEN n_len_mid / n_len * 100 ELSE 0 END::DOUBLE AS len_mid_pct, CASE WHEN n_gap > 0 THEN n_gap_mid / n_gap * 100 ELSE 0 END::DOUBLE AS gap_mid_pct, (n_len_mid + n_gap_mid) / (n_len + n_gap) AS mid_rate FROM n"""
    out["a13_payload_signature"] = f"""WITH {q.CUES} SELECT track_id, sha1('[' || string_agg(to_json({{'i': seq, 't': text}})::VARCHAR, ',' ORDER BY seq) || ']') AS signature FROM cues GROUP BY 1"""

    # ------------------------------------------------------------ intervals
    out["i5_excise_spans"] = f"""WITH {q.SPANS}, nb AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s, e) AS n FROM b),
p AS (SELECT track_id, n || ':a' AS seq, s AS t FROM nb UNION ALL SELECT track_id, n || ':b', e FROM nb), sil AS (SELECT track_id, s, e FROM spans WHERE kind = 'signup'), {SNAPPED},
c AS (SELECT nb.track_id, CASE WHEN y.t > x.t THEN x.t ELSE nb.s END AS s, CASE WHEN y.t > x.t THEN y.t ELSE nb.e END AS e FROM nb JOIN snap x ON x.track_id = nb.track_id AND x.seq = nb.n || ':a' JOIN snap y ON y.track_id = nb.track_id AND y.seq = nb.n || ':b' WHERE nb.track_id IN (SELECT track_id FROM a)),
{coalesced(name="bc", of="c")}, {q.PIECES} SELECT track_id, seq, s AS "start", e AS "end" FROM pieces WHERE e - s >= 0.4 OR track_id NOT IN (SELECT track_id FROM b)"""
    out["i8_expand_blocks"] = f"""WITH {q.SPANS}, {q.CORES}, seg AS (SELECT *, sum(CASE WHEN s - pe <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS block
  FROM (SELECT *, lag(e) OVER (PARTITION BY track_id ORDER BY s, e, seq) AS pe FROM spans WHERE kind = 'view')),
mk AS (SELECT *, EXISTS (SELECT 1 FROM spans o WHERE o.kind = 'click' AND o.track_id = seg.track_id AND least(o.e, seg.e) > greatest(o.s, seg.s)) AND NOT EXISTS (SELECT 1 FROM core o WHERE o.track_id = seg.track_id AND least(o.e, seg.e) > greatest(o.s, seg.s)) AS clean FROM seg),
hull AS (SELECT track_id, block, min(s) AS s, arg_max(e, {{'s': s, 'e': e}}) AS e, min(s) FILTER (NOT clean) AS f, arg_max(e, {{'s': s, 'e': e}}) FILTER (NOT clean) AS t FROM mk GROUP BY 1, 2),
u AS (SELECT track_id, s, e FROM b UNION ALL SELECT track_id, f, t FROM hull WHERE f IS NOT NULL AND EXISTS (SELECT 1 FROM x WHERE x.track_id = hull.track_id AND least(x.e, hull.e) > greatest(x.s, hull.s))),
{coalesced(name="done", of="u")} SELECT track_id, s AS "start", e AS "end" FROM done"""
    kinds = ", ".join(coalesced(name=n, of=f"(SELECT * FROM spans WHERE kind = '{k}')") for n, k in (("voice", "view"), ("songs", "error"), ("speech", "click"), ("saved", "purchase")))
    out["i12_timing_reference"] = f"""WITH {q.SPANS}, {kinds}, {LEFT_OVER.format(name="sung", x="songs", y="speech")}, {coalesced(name="cut", of="sung")}, {LEFT_OVER.format(name="keep", x="voice", y="cut")}, {LEFT_OVER.format(name="plus", x="saved", y="songs")},
u AS (SELECT * FROM keep WHERE e - s >= 0.4 OR track_id NOT IN (SELECT track_id FROM sung) UNION ALL SELECT * FROM plus), {coalesced(name="done", of="u")} SELECT track_id, s AS "start", e AS "end" FROM done"""
    runs = """{n}h AS (SELECT track_id, t, lag(t + 2) OVER (PARTITION BY track_id ORDER BY t) AS pe FROM w WHERE {f}),
{n} AS (SELECT track_id, min(t) AS s, max(t) + 2 AS e FROM (SELECT *, sum(CASE WHEN t - pe <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS isle FROM {n}h) GROUP BY track_id, isle HAVING max(t) + 2 - min(t) >= 6)"""
    song, clean = runs.format(n="song", f="(sing > speech AND sing > 0.15) OR (music > 0.30 AND speech < 0.25)"), runs.format(n="clean", f="speech > 0.5 AND sing < 0.10 AND music < 0.20")
    out["i15_song_detection"] = f"""WITH {q.SCORES}, {song}, {clean} SELECT track_id, s AS "start", e AS "end", 'song' AS kind FROM song UNION ALL SELECT track_id, s, e, 'speech' FROM clean
UNION ALL SELECT track_id, s, e, 'sing' FROM song WHERE EXISTS (SELECT 1 FROM w WHERE w.track_id = song.track_id AND w.t >= song.s AND w.t < song.e AND sing > speech AND sing > 0.15)"""

    # ------------------------------------------------------------ timing and folds
    out["f7_interpolate"] = f"""WITH {q.SPANS}, u AS (SELECT track_id, seq, s, CASE WHEN kind = 'signup' THEN s ELSE e END AS e, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS i FROM spans),
v AS (SELECT *, e > s AS ok, CASE WHEN e > s THEN {{'i': i, 's': s, 'e': e}} END AS x FROM u),
n AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(x IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM v),
m AS (SELECT *, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p.s + (q.s - p.s) * ((i - p.i) / (q.i - p.i)) ELSE coalesce(p.s, q.s) END AS ms, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p.e + (q.e - p.e) * ((i - p.i) / (q.i - p.i)) ELSE coalesce(p.e, q.e) END AS me FROM n)
SELECT track_id, seq, CASE WHEN ok THEN s ELSE {thousandth('ms')} END AS "start", CASE WHEN ok THEN e ELSE {thousandth('me')} END AS "end" FROM m"""
    out["f1_pack_segments"] = recursive(f"""{q.SPANS}, t AS (SELECT track_id, s, e, row_number() OVER (PARTITION BY track_id ORDER BY s, e) AS k FROM a),
f AS (SELECT track_id, k, s AS xs, e AS xe, CASE WHEN e - s > 12 THEN NULL ELSE s END AS s, CASE WHEN e - s > 12 THEN NULL ELSE e END AS e, NULL::DOUBLE AS ds, NULL::DOUBLE AS de, e - s > 12 AS hard FROM t WHERE k = 1
  UNION ALL SELECT t.track_id, t.k, t.s, t.e, CASE WHEN f.s IS NOT NULL AND t.e - f.s <= 12 THEN f.s WHEN t.e - t.s > 12 THEN NULL ELSE t.s END, CASE WHEN f.s IS NOT NULL AND t.e - f.s <= 12 THEN t.e WHEN t.e - t.s > 12 THEN NULL ELSE t.e END,
    CASE WHEN f.s IS NOT NULL AND t.e - f.s > 12 THEN f.s END, CASE WHEN f.s IS NOT NULL AND t.e - f.s > 12 THEN f.e END, NOT coalesce(t.e - f.s <= 12, false) AND t.e - t.s > 12 FROM f JOIN t ON t.track_id = f.track_id AND t.k = f.k + 1),
o AS (SELECT track_id, k, -1 AS j, ds AS s, de AS e FROM f WHERE ds IS NOT NULL UNION ALL SELECT track_id, k, j, xs + j * 12::DOUBLE, least(xs + (j + 1) * 12::DOUBLE, xe) FROM f, range(0, 100) AS r(j) WHERE hard AND j < ceil((xe - xs) / 12::DOUBLE)
  UNION ALL SELECT track_id, k + 1, -1, s, e FROM f WHERE s IS NOT NULL AND k = (SELECT max(k) FROM t WHERE t.track_id = f.track_id))
SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY k, j) - 1)::INT AS chunk_no, s AS "start", e AS "end" FROM o""")
    pushed = lambda want: f"""nt AS (SELECT track_id, seq, s, e, lead(s) OVER w AS na, lead(e) OVER w AS nb, row_number() OVER w AS k FROM cues WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
mf AS (SELECT track_id, k, seq, s AS a, e, na, nb, s + {want}::DOUBLE AS target FROM nt WHERE k = 1
  UNION ALL SELECT nt.track_id, nt.k, nt.seq, CASE WHEN mf.target > mf.na AND mf.target < mf.nb - {want}::DOUBLE / 2 THEN mf.target ELSE nt.s END, nt.e, nt.na, nt.nb, CASE WHEN mf.target > mf.na AND mf.target < mf.nb - {want}::DOUBLE / 2 THEN mf.target ELSE nt.s END + {want}::DOUBLE
  FROM mf JOIN nt ON nt.track_id = mf.track_id AND nt.k = mf.k + 1),
held AS (SELECT track_id, seq, a AS s, greatest(CASE WHEN na IS NULL THEN greatest(e, target) WHEN target <= na THEN least(greatest(e, target), na) WHEN target < nb - {want}::DOUBLE / 2 THEN target ELSE na END, a + 0.001) AS e FROM mf)"""  # noqa: E731
    out["f4_min_duration"] = recursive(f"""{q.CUES}, {pushed(0.8)} SELECT track_id, seq, s AS "start", e AS "end" FROM held""")
    out["f13_align_finish"] = recursive(f"""{q.CUES}, {pushed(0.0)}, l AS (SELECT *, lead(s, 1) OVER w AS n1, lead(s, 2) OVER w AS n2 FROM held WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
r AS (SELECT track_id, seq, s, CASE WHEN e - s < 0.2 THEN greatest(e, CASE WHEN n1 IS NULL OR s + 0.5 <= n1 THEN s + 0.5 ELSE least(s + 0.5, coalesce(n2, 1e300)) END) ELSE e END AS e FROM l) SELECT track_id, seq, s AS "start", greatest(e, s + 0.05) AS "end" FROM r""")
    out["f2_alignment_chunks"] = recursive(f"""{q.CUES}, c AS (SELECT track_id, seq - min(seq) OVER (PARTITION BY track_id) AS k, s, e, lead(s) OVER (PARTITION BY track_id ORDER BY seq) AS nx, count(*) OVER (PARTITION BY track_id) AS n, max(e) OVER (PARTITION BY track_id) AS last FROM cues),
reach AS (SELECT x.track_id, x.k, x.n, coalesce(max(y.k) FILTER (y.nx - y.e >= 1.5), max(y.k), x.k) AS cut FROM c x LEFT JOIN c y ON y.track_id = x.track_id AND y.k >= x.k AND y.k < y.n - 1 AND y.e <= x.s + 60 WHERE x.last - x.s > 60 GROUP BY 1, 2, 3),
hop AS (SELECT track_id, 0 AS lo FROM c WHERE k = 0 UNION ALL SELECT hop.track_id, cut + 1 FROM hop JOIN reach ON reach.track_id = hop.track_id AND reach.k = hop.lo WHERE cut < n - 1),
r AS (SELECT *, lead(lo) OVER (PARTITION BY track_id ORDER BY lo) AS hi FROM hop)
SELECT r.track_id, r.lo::INT AS lo, coalesce(r.hi, h.n)::INT AS hi, CASE WHEN r.lo = 0 THEN greatest(0, h.s - 0.5) ELSE (x.e + x.nx) / 2 END AS "start", CASE WHEN r.hi IS NULL THEN h.last + 0.5 ELSE (y.e + y.nx) / 2 END AS "end"
FROM r JOIN c h ON h.track_id = r.track_id AND h.k = 0 LEFT JOIN c x ON x.track_id = r.track_id AND x.k = r.lo - 1 LEFT JOIN c y ON y.track_id = r.track_id AND y.k = r.hi - 1""")
    out["q7_pack_words"] = recursive(f"""{q.WORDS}, t AS (SELECT track_id, seq, s, e, {wide("text")} AS w, coalesce((s - lag(e) OVER (PARTITION BY track_id ORDER BY seq)) * 1000 >= 700, false) AS brk FROM words),
f AS (SELECT track_id, seq, w AS held, s AS since, 0 AS cue FROM t WHERE seq = 0
  UNION ALL SELECT t.track_id, t.seq, CASE WHEN t.brk OR f.held + 1 + t.w > 84 OR t.e - f.since > 7 THEN t.w ELSE f.held + 1 + t.w END, CASE WHEN t.brk OR f.held + 1 + t.w > 84 OR t.e - f.since > 7 THEN t.s ELSE f.since END, CASE WHEN t.brk OR f.held + 1 + t.w > 84 OR t.e - f.since > 7 THEN f.cue + 1 ELSE f.cue END
  FROM f JOIN t ON t.track_id = f.track_id AND t.seq = f.seq + 1) SELECT track_id, seq, cue FROM f""")

    short_cues = q.CUES.replace(">= 700", ">= 400")
    glue = "trim(rtrim({a}) || ' ' || ltrim({b}))"
    both = glue.format(a="f.text", b="c.text")
    joins = f"c.s - f.e < 0.5 AND ((c.e - f.s <= 7 AND {wide(both)} <= 42) OR greatest(f.e - f.s, c.e - c.s) < 0.08 OR c.e - f.s < 0.5)"
    out["t2_merge_micro"] = recursive(f"""{short_cues}, c AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k, text, s, e FROM cues),
f AS (SELECT track_id, k, 0 AS g, text, s, e FROM c WHERE k = 1 UNION ALL SELECT track_id, k, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN both_text ELSE text END, CASE WHEN j THEN fs ELSE s END, CASE WHEN j THEN greatest(fe, e) ELSE e END
  FROM (SELECT c.track_id, c.k, f.g, c.text, c.s, c.e, f.s AS fs, f.e AS fe, {both} AS both_text, {joins} AS j FROM f JOIN c ON c.track_id = f.track_id AND c.k = f.k + 1))
SELECT track_id, g AS seq, arg_max(text, k) AS text, arg_max(s, k) AS "start", arg_max(e, k) AS "end" FROM f GROUP BY 1, 2""")
    lines = "(list_reduce(list_transform(regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\x0B]+'), lambda w: {{'u': 1, 'a': {w}, 'm': {w}}}), lambda p, q: CASE WHEN p.a + 1 + q.a > 42 THEN {{'u': p.u + 1, 'a': q.a, 'm': greatest(p.m, q.m)}} ELSE {{'u': p.u, 'a': p.a + 1 + q.a, 'm': greatest(p.m, q.m)}} END))".replace("{w}", wide("w").replace("{", "{{").replace("}", "}}"))
    two = lambda x: f"({lines.format(x=x)}.u <= 2 AND {lines.format(x=x)}.m <= 42)"
    out["t3_glue_fragments"] = recursive(f"""{short_cues}, c AS (SELECT track_id, row_number() OVER w AS k, text, s, e, lead(text) OVER w AS nt, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM cues WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
f AS (SELECT track_id, 0::BIGINT AS k, -1 AS g, NULL::VARCHAR AS text, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::VARCHAR AS ct, NULL::DOUBLE AS cs FROM (SELECT DISTINCT track_id FROM c)
  UNION ALL SELECT track_id, k, CASE WHEN act = 'new' THEN g + 1 ELSE g END, CASE act WHEN 'new' THEN x WHEN 'back' THEN jb ELSE pt END, CASE WHEN act = 'new' THEN xs ELSE ps END, CASE act WHEN 'new' THEN xe WHEN 'back' THEN greatest(pe, xe) ELSE pe END, CASE WHEN act = 'on' THEN x END, CASE WHEN act = 'on' THEN xs END
  FROM (SELECT *, CASE WHEN frag AND ahead IS NOT NULL AND (back IS NULL OR ahead < back) THEN 'on' WHEN frag AND back IS NOT NULL THEN 'back' ELSE 'new' END AS act
    FROM (SELECT *, CASE WHEN g >= 0 AND xs - pe < 0.5 AND xe - ps <= 7 AND {two('jb')} THEN xs - pe END AS back, CASE WHEN ns IS NOT NULL AND ns - xe < 0.5 AND ne - xs <= 7 AND {two('ja')} THEN ns - xe END AS ahead,
        NOT regexp_matches(trim(x), '[ \t\n\r\f\x0B]') AND trim(x) <> '' AND length(regexp_replace(trim(x), ',+$', '')) <= 12 AS frag
      FROM (SELECT *, {glue.format(a="pt", b="x")} AS jb, {glue.format(a="x", b="nt")} AS ja FROM (SELECT c.track_id, c.k, f.g, f.text AS pt, f.s AS ps, f.e AS pe, CASE WHEN f.ct IS NULL THEN c.text ELSE {glue.format(a="f.ct", b="c.text")} END AS x, least(coalesce(f.cs, c.s), c.s) AS xs, c.e AS xe, c.nt, c.ns, c.ne FROM f JOIN c ON c.track_id = f.track_id AND c.k = f.k + 1)))))
SELECT track_id, g AS seq, arg_max(text, k) AS text, arg_max(s, k) AS "start", arg_max(e, k) AS "end" FROM f WHERE g >= 0 GROUP BY 1, 2""")
    frame, two_frames, landing = "(1::DOUBLE / 24)", "(2::DOUBLE / 24)", "(12 * (1::DOUBLE / 24))"
    near = lambda side: f"(SELECT p.track_id, p.seq, arg_min(h.t, {{'d': abs(h.t - p.{side}), 't': h.t}}) AS cut FROM polished p JOIN h ON h.track_id = p.track_id AND abs(h.t - p.{side}) <= 0.458 GROUP BY 1, 2)"
    moved = f"CASE WHEN s - sc < 0 THEN CASE WHEN s - sc >= -7 * {frame} - 1e-9 THEN sc ELSE sc - {landing} END WHEN s - sc <= 9 * {frame} + 1e-9 THEN sc ELSE sc + {landing} END"
    out["t4_snap_to_shots"] = recursive(f"""{q.POLISHED}, h AS (SELECT DISTINCT track_id, s AS t FROM words WHERE seq % 7 = 0), sn AS {near("s")}, en AS {near("e")},
c AS (SELECT p.track_id, p.seq, row_number() OVER w AS k, p.s, p.e, cues.e AS spoken, lead(p.s) OVER w AS nx, sn.cut AS sc, en.cut AS ec FROM polished p JOIN cues USING (track_id, seq) LEFT JOIN sn USING (track_id, seq) LEFT JOIN en USING (track_id, seq) WINDOW w AS (PARTITION BY p.track_id ORDER BY p.seq)),
f AS (SELECT track_id, 0::BIGINT AS k, NULL::INT AS seq, NULL::DOUBLE AS s, NULL::DOUBLE AS e FROM (SELECT DISTINCT track_id FROM c)
  UNION ALL SELECT track_id, k, seq, s1, CASE WHEN ec IS NULL THEN e WHEN (CASE WHEN target > e + 1e-9 THEN target <= coalesce(nx, 1e300) - {two_frames} AND target - s1 <= 7 ELSE target < e - 1e-9 AND target >= spoken AND target > s1 END) THEN target
    WHEN near AND e > ec AND ec + {landing} > e AND ec + {landing} <= coalesce(nx, 1e300) - {two_frames} AND ec + {landing} - s1 <= 7 THEN ec + {landing} ELSE e END
  FROM (SELECT *, e - ec <= 5 * {frame} + 1e-9 AS near, CASE WHEN e - ec <= 5 * {frame} + 1e-9 THEN ec - {two_frames} ELSE ec + {landing} END AS target, CASE WHEN sc IS NOT NULL AND abs(sc - s) > 1e-9 AND new < e - {two_frames} AND new - s <= {landing} THEN new ELSE s END AS s1
    FROM (SELECT *, greatest({moved}, coalesce(pe + {two_frames}, {moved})) AS new FROM (SELECT c.*, f.e AS pe FROM f JOIN c ON c.track_id = f.track_id AND c.k = f.k + 1))))
SELECT track_id, seq, s AS "start", e AS "end" FROM f WHERE k > 0""")

    # ------------------------------------------------------------ text
    out["x8_strip_for_translation"] = "SELECT doc_id, trim(regexp_replace(translate(" + q.STRIP.format(t=f"translate(text, '{EXTRA_DROPPED}', repeat(' ', {len(EXTRA_DROPPED)}))") + r", chr(3) || chr(4), '.,'), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS plain FROM documents"
    out["x6_merge_stutters"] = f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {stuttered('text')} END AS joined FROM documents"
    out["x11_wrap"] = f"WITH {q.CUES}, {wrapped('cues', q.END_PENALTY)} SELECT track_id, seq, text FROM wrapped"
    plain = "trim(regexp_replace(translate(" + q.STRIP.format(t="text") + r", chr(3) || chr(4), '.,'), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"
    out["q12_full_replay"] = f"""WITH {q.POLISHED}, bare AS (SELECT track_id, seq, lang, {plain} AS text FROM polished), joined AS (SELECT track_id, seq, lang, {stuttered("text")} AS text FROM bare), {wrapped("joined", q.END_PENALTY)}
SELECT track_id, seq, wrapped.text, s AS "start", e AS "end" FROM polished JOIN wrapped USING (track_id, seq)"""
    out["x21_sentences"] = f"""WITH p AS (SELECT doc_id AS track_id, list_filter(string_split(regexp_replace(text, '([.!?。！？]){SPACE}*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM documents),
t AS (SELECT track_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS sentence FROM p)
SELECT track_id, sentence, text, coalesce(sum(length(regexp_replace(text, '{SPACE}', '', 'g'))) OVER (PARTITION BY track_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t"""
    out["x17_legal_break"] = f"""WITH {q.CUES}, w AS (SELECT track_id, seq, lang, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS u FROM cues), t AS (SELECT *, len(u) AS n, greatest(1, least(len(u) // 2, len(u))) AS aim FROM w),
ok AS (SELECT track_id, seq, arg_min(i, {{'d': abs(i - aim), 'i': i}}) AS best FROM t, range(1, 10000) AS r(i) WHERE i < n AND lower(trim(u[i], '.,!?;:')) NOT IN {q.BINDS} GROUP BY 1, 2)
SELECT track_id, seq, CASE WHEN n <= 1 OR lang <> 'en' THEN aim ELSE coalesce(best, aim) END::INT AS "at" FROM t LEFT JOIN ok USING (track_id, seq)"""
    marks = r"regexp_replace({t}, '([^\x01])(—|–|--+|…|\.\.\.)([^\x01])', '\1\2' || chr(1) || '\3', 'g')"
    out["x29_break_tokens"] = f"WITH {q.TOKENS}, s AS (SELECT track_id, seq, string_split({marks.format(t=marks.format(t='text'))}, chr(1)) AS l FROM tok) SELECT track_id, seq, generate_subscripts(l, 1) - 1 AS part, unnest(l) AS text FROM s"
    out["f16_character_units"] = f"""WITH {q.WORDS}, c AS (SELECT track_id, seq, s, greatest(e - s, 0) AS d, list_filter(string_split(text, ''), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS l FROM words),
u AS (SELECT track_id, seq, s, d, len(l) AS n, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS k FROM c) SELECT track_id, seq, k, text, s + d * k / n AS "start", s + d * (k + 1) / n AS "end" FROM u"""

    visible = lambda t: f"length(regexp_replace(regexp_replace(trim({t}), ',+$', ''), '{SPACE}', '', 'g'))"
    commas = lambda t: f"(length(regexp_replace(trim({t}), ',+$', '')) - length(replace(regexp_replace(trim({t}), ',+$', ''), ',', '')))"
    over, now = f"(a.o <> '' AND {commas('(a.o || b.o)')} > 1)", "(CASE WHEN {over} THEN b.o ELSE a.o || b.o END)"
    now = now.format(over=over)
    grown = f"CASE WHEN {visible(now)} >= 18 THEN list_append(CASE WHEN {over} THEN list_append(a.d, a.o) ELSE a.d END, {now}) WHEN {over} THEN list_append(a.d, a.o) ELSE a.d END"
    clause_rows = f"""se AS (SELECT doc_id AS track_id, lang, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, lang, list_filter(string_split(regexp_replace(text, '([.!?。！？]){SPACE}*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM documents)),
fo AS (SELECT track_id, lang, i, list_reduce(list_prepend({{'d': []::VARCHAR[], 'o': ''}}, list_transform(string_split(regexp_replace(s, ',({SPACE})', ',' || chr(1) || '\\1', 'g'), chr(1)), lambda p: {{'d': []::VARCHAR[], 'o': p}})), lambda a, b: {{'d': {grown}, 'o': CASE WHEN {visible(now)} >= 18 THEN '' ELSE {now} END}}) AS f FROM se),
fi AS (SELECT track_id, lang, i, CASE WHEN f.o = '' THEN f.d WHEN len(f.d) > 0 AND {visible("f.o")} < 18 AND {commas("(f.d[-1] || f.o)")} <= 1 THEN list_append(f.d[1:len(f.d) - 1], f.d[-1] || f.o) ELSE list_append(f.d, f.o) END AS l FROM fo),
cr AS (SELECT track_id, lang, i, unnest(l) AS text, generate_subscripts(l, 1) AS j FROM fi),
cl AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i, j) - 1 AS seq, lang, trim(text) AS text, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '')) AS n FROM cr WHERE trim(text) <> '')"""
    out["x19_comma_clauses"] = f"WITH {clause_rows} SELECT track_id, seq, lang, text, n FROM cl"
    out["q1_clause_cues"] = f"""WITH {q.WORDS}, {clause_rows}, ce AS (SELECT *, sum(n) OVER (PARTITION BY track_id ORDER BY seq) AS hi FROM cl), wk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS k FROM words)
SELECT ce.track_id, ce.seq, ce.lang, ce.text, arg_min(wk.s, wk.k) AS "start", arg_max(wk.e, wk.k) AS "end" FROM ce LEFT JOIN wk ON wk.track_id = ce.track_id AND wk.k >= ce.hi - ce.n AND wk.k < ce.hi GROUP BY 1, 2, 3, 4"""

    # ------------------------------------------------------------ edits, speakers, boundaries
    lower = "CASE WHEN length(trim(text)) >= 0 THEN trim(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]*[-–—]+[ \\t\\n\\r\\f\\x0B]*', ''), '[ \\t\\n\\r\\f\\x0B\\x{0085}\\x{00A0}]+', ' ', 'g')) END"
    out["c1_payload_units"] = f"""WITH t AS (SELECT conv_id AS track_id, turn AS i, text, {lower} AS flat FROM conversations) SELECT track_id, i, CASE WHEN i % 2 = 1 THEN CASE WHEN flat <> '' THEN 'a' || chr(10) || flat END ELSE trim(replace(text, chr(10), ' ')) END AS t FROM t WHERE i % 2 = 0 OR flat <> ''"""
    clean = "trim(regexp_replace(translate(" + q.STRIP.format(t=f"translate({{t}}, '{EXTRA_DROPPED}', repeat(' ', {len(EXTRA_DROPPED)}))") + r", chr(3) || chr(4), '.,'), '[\s\x0B\x{0085}\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"
    out["c5_translated_cues"] = f"""WITH src AS (SELECT conv_id AS track_id, turn AS seq, 'en' AS lang, {clean.replace("{t}", "CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN replace(upper(text), 'ẞ', 'SS') ELSE text END")} AS text FROM conversations), {wrapped("src", q.END_PENALTY)}
SELECT track_id, seq, CASE WHEN seq % 5 = 0 THEN '♪ ' || text || ' ♪' ELSE text END AS text, seq % 5 = 0 AS lyric FROM wrapped"""
    lines_of = f"""{q.CUES}, {wrapped("cues", q.END_PENALTY)}, sp AS (SELECT cues.track_id, cues.seq, lang, s, e, unnest(string_split(wrapped.text, chr(10))) AS text, generate_subscripts(string_split(wrapped.text, chr(10)), 1) - 1 AS part FROM cues JOIN wrapped USING (track_id, seq)),
sh AS (SELECT *, greatest(length(regexp_replace(text, '{SPACE}', '', 'g')), 1) AS n FROM sp), su AS (SELECT *, sum(n) OVER (PARTITION BY track_id, seq) AS whole, sum(n) OVER (PARTITION BY track_id, seq ORDER BY part) AS upto FROM sh)"""
    out["q10_untimed_cues"] = f"""WITH {lines_of} SELECT track_id, seq, part, lang, text, s + (e - s) * (upto - n) / whole AS "start", s + (e - s) * upto / whole AS "end" FROM su"""
    turns = f"""{q.WORDS}, tr AS (SELECT track_id, floor(s / 9) AS n, min(s) AS s, max(e) AS e FROM words GROUP BY 1, 2), sp AS (SELECT track_id, n, s, e, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS speaker FROM tr),
cw AS (SELECT *, row_number() OVER (PARTITION BY track_id, cue ORDER BY seq) - 1 AS k FROM (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cue FROM (SELECT *, CASE WHEN (s - lag(e) OVER (PARTITION BY track_id ORDER BY seq)) * 1000 >= 700 THEN 1 ELSE 0 END AS brk FROM words))),
ov AS (SELECT cw.track_id, cue, k, speaker, round(sum(least(cw.e, sp.e) - greatest(cw.s, sp.s)), 6) AS o, min((sp.s, sp.e, sp.n)) AS f FROM cw JOIN sp ON sp.track_id = cw.track_id AND least(cw.e, sp.e) > greatest(cw.s, sp.s) GROUP BY 1, 2, 3, 4),
bs AS (SELECT track_id, cue, k, speaker FROM (SELECT *, row_number() OVER (PARTITION BY track_id, cue, k ORDER BY o DESC, f) AS r FROM ov) WHERE r = 1 AND o >= 0.05),
lb AS (SELECT cw.track_id, cw.cue, cw.k, cw.text, cw.s, cw.e, coalesce(last_value(speaker IGNORE NULLS) OVER w, first_value(speaker IGNORE NULLS) OVER (PARTITION BY cw.track_id, cw.cue ORDER BY cw.k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM cw LEFT JOIN bs ON bs.track_id = cw.track_id AND bs.cue = cw.cue AND bs.k = cw.k WINDOW w AS (PARTITION BY cw.track_id, cw.cue ORDER BY cw.k ROWS UNBOUNDED PRECEDING))"""
    out["d1_speaker_runs"] = f"""WITH {turns} SELECT track_id, cue::INT AS cue, k, speaker, sum(new) OVER (PARTITION BY track_id, cue ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN k > 0 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY track_id, cue ORDER BY k) THEN 0 ELSE 1 END AS new FROM lb)"""
    out["d3_snap_to_phrases"] = f"""WITH {turns}, ph AS (SELECT *, CASE WHEN k % 7 < 6 THEN k // 3 END AS phrase FROM lb), m AS (SELECT track_id, cue, phrase, arg_min(speaker, {{'t': -tm, 'k': fk}}) AS main FROM (SELECT track_id, cue, phrase, speaker, sum(greatest(0, e - s)) AS tm, min(k) AS fk FROM ph WHERE phrase IS NOT NULL AND speaker IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT ph.track_id, ph.cue::INT AS cue, ph.k, coalesce(m.main, ph.speaker) AS speaker FROM ph LEFT JOIN m ON m.track_id = ph.track_id AND m.cue = ph.cue AND m.phrase = ph.phrase"""
    out["j15_anchors"] = f"""WITH {q.TOKENS}, h AS (SELECT track_id, seq, trunc(seq + seq / 10 % 7 - 3)::INT AS at, CASE WHEN seq % 50 = 0 THEN reverse(text) ELSE text END AS text FROM tok WHERE seq % 10 = 0),
b AS (SELECT h.track_id, h.seq, arg_min(w.seq, {{'d': abs(w.seq - h.at), 'n': -w.seq}}) AS found FROM h JOIN tok w ON w.track_id = h.track_id AND w.seq BETWEEN h.at - 8 AND h.at + 8 AND trim(w.text) = trim(h.text) GROUP BY 1, 2)
SELECT h.track_id, h.seq, h.text, coalesce(b.found, h.at)::INT AS found, b.found IS NOT NULL AS ok FROM h LEFT JOIN b USING (track_id, seq)"""
    out["a9_path_quality"] = f"WITH {q.SPANS} SELECT track_id, round(sum((seq * 37 % 101) * (1 + seq % 3)) / sum(1 + seq % 3), 9) AS average, min(seq * 37 % 101) AS worst FROM spans GROUP BY 1"
    out["b8_choose_option"] = f"""WITH {q.SPANS}, o AS (SELECT track_id, seq // 8 AS win, seq AS option, seq % 8 = 0 AS fb, (seq * 13 % 17 / 8 + seq * 7 % 19 / 8) / 2 + seq % 3 / 8 - seq % 5 / 8 AS sc FROM spans), bs AS (SELECT *, max(CASE WHEN fb THEN sc END) OVER (PARTITION BY track_id, win) AS base FROM o)
SELECT track_id, win AS "window", option, fb AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY track_id, win ORDER BY sc DESC, fb DESC, option) AS r FROM bs WHERE fb OR sc - base >= 0.2) WHERE r = 1"""
    out["b11_whole_or_baseline"] = f"""WITH {q.SPANS}, p AS (SELECT track_id, seq AS src, seq + 1 + seq % 2 AS dst, 1 + seq % 2 AS w, CASE WHEN seq % 1009 <> 0 THEN seq * 37 % 101 END AS qa, CASE WHEN seq % 97 <> 0 THEN seq * 41 % 101 END AS qb FROM a),
v AS (SELECT track_id, coalesce(bool_and(qb IS NOT NULL) AND sum(qb * w) / sum(w) + 15 >= sum(qa * w) / sum(w) AND min(qb) + 25 >= min(qa), false) AS take FROM p GROUP BY 1)
SELECT track_id, src, dst, CASE WHEN take THEN qb ELSE qa END AS quality, CASE WHEN take THEN 'candidate' ELSE 'baseline' END AS source FROM p JOIN v USING (track_id)"""
    bounded = f"""{q.WORDS}, hb AS (SELECT *, coalesce((s - lag(e) OVER w) * 1000 >= 700 OR regexp_matches(lag(text) OVER w, '[.!?。！？]$'), false) AS must FROM words WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
bl AS (SELECT *, sum(must::INT) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block FROM hb), pt AS (SELECT *, (row_number() OVER (PARTITION BY track_id, block ORDER BY seq) - 1) // 96 AS part FROM bl),
wn AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY block, part) - 1 AS win FROM pt)"""
    out["b1_hard_boundaries"] = f'WITH {bounded} SELECT track_id, seq, must, win AS "window" FROM wn'
    read = f"length(regexp_replace({plain}, '{SPACE}', '', 'g'))"
    out["b4_edge_quality"] = f"""WITH {bounded}, rw AS (SELECT *, lead(s) OVER (PARTITION BY track_id ORDER BY seq) AS nx, {wide("text")} + 1 AS v, {read} AS c FROM wn), sm AS (SELECT *, sum(v) OVER w AS vs, sum(c) OVER w AS cs FROM rw WINDOW w AS (PARTITION BY track_id, win ORDER BY seq ROWS UNBOUNDED PRECEDING)),
ed AS (SELECT a.track_id, a.win, a.seq AS src, b.seq + 1 AS dst, a.s, b.e, b.cs - a.cs + a.c AS chars, b.nx, b.e - a.s AS spoken FROM sm a JOIN sm b ON b.track_id = a.track_id AND b.win = a.win AND b.seq >= a.seq AND b.seq < a.seq + 96 WHERE b.vs - (a.vs - a.v) - 1 <= 84 AND b.e - a.s <= 7.0 + 1e-9),
rm AS (SELECT *, greatest(0.0::DOUBLE, least(greatest(spoken, least(e + greatest(1.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE - spoken), coalesce(nx, e + greatest(1.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE - spoken))) - s), 7.0::DOUBLE)) AS room FROM ed)
SELECT track_id, win AS "window", src, dst, greatest(0, least(100, round_even(100 * (0.30::DOUBLE * least(1.0::DOUBLE, room / 1.0::DOUBLE) + 0.45::DOUBLE * CASE WHEN chars > 0 THEN least(1.0::DOUBLE, room / (chars / 17::DOUBLE)) ELSE 1 END + 0.25::DOUBLE * least(1.0::DOUBLE, room / ((dst - src) / 3::DOUBLE))), 0)::INT)) AS quality FROM rm"""
    graph = out["b4_edge_quality"].replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT track_id, win", 1)[0].rstrip() + ', e AS (SELECT track_id, win AS "window", src, dst FROM rm {some}), z AS (SELECT track_id, "window", min(src) AS first, max(dst) AS last FROM e GROUP BY 1, 2)'
    out["b5_fewest_cues"] = graph.replace("{some}", "") + """, r(track_id, "window", n, node, path) AS (SELECT track_id, "window", 0, first, []::BIGINT[] FROM z UNION ALL
  SELECT r.track_id, r."window", n + 1, dst, min(CASE WHEN dst < last THEN list_append(path, dst::BIGINT) ELSE path END) FROM r JOIN z ON z.track_id = r.track_id AND z."window" = r."window" AND node < last JOIN e ON e.track_id = r.track_id AND e."window" = r."window" AND e.src = node GROUP BY ALL),
b AS (SELECT r.track_id, r."window", arg_min(path, n) AS breaks, min(n) AS cues FROM r JOIN z ON z.track_id = r.track_id AND z."window" = r."window" AND node = last GROUP BY 1, 2)
SELECT z.track_id, z."window", first, last, breaks, cues FROM z LEFT JOIN b ON b.track_id = z.track_id AND b."window" = z."window\""""
    out["b3_complete_paths"] = graph.replace("{some}", "WHERE (src * 7 + dst * 13) % 5 < 3") + """, f(track_id, "window", node) AS (SELECT track_id, "window", first FROM z UNION SELECT e.track_id, e."window", dst FROM f JOIN e ON e.track_id = f.track_id AND e."window" = f."window" AND src = node),
g(track_id, "window", node) AS (SELECT track_id, "window", last FROM z UNION SELECT e.track_id, e."window", src FROM g JOIN e ON e.track_id = g.track_id AND e."window" = g."window" AND dst = node)
SELECT e.track_id, e."window", src, dst FROM e JOIN f ON f.track_id = e.track_id AND f."window" = e."window" AND f.node = src JOIN g ON g.track_id = e.track_id AND g."window" = e."window" AND g.node = dst"""
    out["b6_boundary_penalties"] = f"""WITH {q.WORDS}, l AS (SELECT *, lag(text) OVER w AS pt, (s - lag(e) OVER w) * 1000 AS gap FROM words WINDOW w AS (PARTITION BY track_id ORDER BY seq))
SELECT track_id, seq, 3 * (coalesce({q.END_PENALTY.format(t="pt", l="lang")}, 0) + CASE WHEN contains('{q.tx.NOT_AT_START}', text[1:1]) THEN 2 ELSE 0 END) + CASE WHEN gap < 40 THEN 3 WHEN gap < 120 THEN 2 WHEN gap < 220 THEN 1 ELSE 0 END AS damage FROM l"""

    # ------------------------------------------------------------ atoms and options
    reduced = "list_reduce(list_transform(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'), lambda w: {'t': w, 'a': " + wide("w") + "}), lambda p, q: CASE WHEN p.a + 1 + q.a > 42 THEN {'t': p.t || chr(10) || q.t, 'a': q.a} ELSE {'t': p.t || ' ' || q.t, 'a': p.a + 1 + q.a} END).t"
    out["x4_soft_wrap"] = f"WITH {q.CUES} SELECT track_id, seq, {reduced} AS text FROM cues"
    out["f15_windows_of_forty"] = recursive(f"""{q.CUES}, c AS (SELECT track_id, seq, length(text) AS n, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k FROM cues),
f AS (SELECT track_id, seq, k, 0 AS "window", 1 AS held, n AS size FROM c WHERE k = 1 UNION ALL
  SELECT c.track_id, c.seq, c.k, CASE WHEN held = 40 OR size + n > 2000 THEN "window" + 1 ELSE "window" END, CASE WHEN held = 40 OR size + n > 2000 THEN 1 ELSE held + 1 END, CASE WHEN held = 40 OR size + n > 2000 THEN n ELSE size + n END
  FROM f JOIN c ON c.track_id = f.track_id AND c.k = f.k + 1) SELECT track_id, seq, "window" FROM f""")
    run, signs, quoted = f"[A-Za-z0-9._-]+(?:{SPACE}+[A-Za-z0-9._-]+)*", f"[{UNIT_SIGNS}]", ", ".join
    listed = lambda xs: quoted(f"'{x}'" for x in xs)
    unit = f"(?:[A-Za-z0-9._-]+{SPACE}+)*[A-Za-z0-9._-]*[0-9]{SPACE}*{signs}|{run}|{SPACE.replace('[', '[^', 1)}"
    room = f"(CASE WHEN lang IN ({listed(ONE_LINE)}) THEN 36 WHEN lang IN ({listed(WIDE)}) THEN 24 ELSE 42 END)"
    langs = listed(POLICY_LANGS)
    out["q2_text_atoms"] = f"""WITH d AS (SELECT doc_id AS track_id, ([{langs}])[doc_id % {len(POLICY_LANGS)} + 1] AS lang, text FROM documents), l AS (SELECT *, lang NOT IN ({listed(UNSPACED_LAYOUT)}) AS loose FROM d),
t AS (SELECT track_id, lang, loose, unnest(x) AS tok, generate_subscripts(x, 1) AS k FROM (SELECT *, CASE WHEN loose THEN regexp_extract_all(text, '{SPACE.replace('[', '[^', 1)}+') ELSE regexp_extract_all(text, '{unit}') END AS x FROM l)),
j AS (SELECT track_id, lang, loose, k, CASE WHEN loose THEN tok ELSE regexp_replace(tok, '([0-9]){SPACE}+({signs})$', '\\1\\2') END AS tok FROM t),
w AS (SELECT *, CASE WHEN NOT loose AND {wide('tok')} > {room} AND regexp_matches(tok, '{SPACE}') THEN regexp_extract_all(tok, '{SPACE.replace('[', '[^', 1)}+{SPACE}*') ELSE [tok] END AS parts FROM j),
p AS (SELECT track_id, lang, loose, k, unnest(parts) AS text, generate_subscripts(parts, 1) AS part FROM w)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY k, part) - 1 AS seq, lang, text, part > 1 AS forced, CASE WHEN loose THEN 1 ELSE length(regexp_replace(text, '{SPACE}', '', 'g')) END AS n FROM p"""
    seen = f"sum(length(regexp_replace(text, '{SPACE}', '', 'g'))) OVER (PARTITION BY track_id ORDER BY seq) - length(regexp_replace(text, '{SPACE}', '', 'g'))"
    out["q3_phrase_starts"] = f"""WITH {q.TOKENS}, a AS (SELECT track_id, seq, {seen} AS at FROM tok), g AS (SELECT track_id, seq // 3 AS seq, string_agg(text, ' ' ORDER BY seq) AS text FROM tok GROUP BY 1, 2), p AS (SELECT DISTINCT track_id, {seen} AS at FROM g)
SELECT a.track_id, a.seq, p.at IS NOT NULL AS phrase FROM a LEFT JOIN p ON p.track_id = a.track_id AND p.at = a.at"""
    out["b2_phrase_windows"] = recursive(f"""{q.WORDS}, m AS (SELECT track_id, seq, coalesce((s - lag(e) OVER w) * 1000 >= 2000, false) OR seq % 331 = 0 AS must FROM words WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
bl AS (SELECT *, sum(must::INT) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, block ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY track_id, block) AS n FROM bl),
h AS (SELECT *, CASE WHEN n - k > 96 THEN coalesce(max(CASE WHEN seq % 7 = 0 THEN k END) OVER (PARTITION BY track_id, block ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 96 FOLLOWING), k + 96) END AS nx FROM k),
r AS (SELECT track_id, block, 0::BIGINT AS k FROM h WHERE k = 0 UNION ALL SELECT r.track_id, r.block, h.nx FROM r JOIN h ON h.track_id = r.track_id AND h.block = r.block AND h.k = r.k WHERE h.nx IS NOT NULL)
SELECT h.track_id, h.seq, (count(r.k) OVER (PARTITION BY h.track_id ORDER BY h.seq ROWS UNBOUNDED PRECEDING) - 1)::INT AS "window" FROM h LEFT JOIN r ON r.track_id = h.track_id AND r.block = h.block AND r.k = h.k""")
    paths = """t AS (SELECT conv_id AS track_id, turn AS src, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), ed AS (SELECT track_id, src, src + j AS dst, n, (src * 37 + (src + j) * 17) % 101 AS q, (src + j) * 5 % 3 AS h FROM t, range(1, 4) AS r(j) WHERE src + j <= n),
al AS (SELECT track_id, n, 0 AS pos, 0 AS total, 0 AS host, []::BIGINT[] AS path, 0 AS cues FROM (SELECT DISTINCT track_id, n FROM t) UNION ALL
  SELECT al.track_id, al.n, ed.dst, al.total + ed.q * (ed.dst - ed.src), al.host + ed.h, CASE WHEN ed.dst < al.n THEN list_append(al.path, ed.dst) ELSE al.path END, al.cues + 1 FROM al JOIN ed ON ed.track_id = al.track_id AND ed.src = al.pos),
fb AS (SELECT track_id, arg_min(path, {'c': cues, 'p': path}) AS base, min(cues) AS fewest FROM al WHERE pos = n GROUP BY 1),
op AS (SELECT al.track_id, row_number() OVER (PARTITION BY al.track_id ORDER BY (path = base) DESC, host, cues, total DESC, path) - 1 AS option, path, cues, total / n AS quality, host, (path = base) AS fallback FROM al JOIN fb USING (track_id) WHERE pos = n AND cues <= fewest + 1)"""
    out["b7_path_options"] = recursive(f"""{paths} SELECT track_id, 0 AS "window", option, array_to_string(path, ',') AS breaks, cues, round(quality, 9) AS quality, host::BIGINT AS host, fallback FROM op WHERE option < 12""")
    replies = ", ".join("'" + r + "'" for r in REPLIES)
    out["b9_checked_choices"] = recursive(f"""{paths}, b AS (SELECT *, [{replies}][track_id % {len(REPLIES)} + 1] AS raw FROM op WHERE fallback),
c AS (SELECT *, CASE WHEN raw = '' THEN 'no reply' WHEN raw = 'the second one' THEN 'no object' WHEN raw LIKE '%breaks%' THEN 'other fields' WHEN raw LIKE '%1.5%' THEN 'no whole number' END AS form, CASE WHEN raw LIKE '%99%' THEN 99 ELSE 1 END AS pick FROM b)
SELECT c.track_id, array_to_string(CASE WHEN form IS NULL AND o.option IS NOT NULL THEN o.path ELSE c.path END, ',') AS breaks, coalesce(form, CASE WHEN o.option IS NULL THEN 'unknown option' END) AS why FROM c LEFT JOIN (SELECT * FROM op WHERE option < 12) o ON o.track_id = c.track_id AND o.option = c.pick""")
    out["b9_path_faults"] = """WITH t AS (SELECT conv_id AS track_id, count(*) AS n FROM conversations GROUP BY 1) SELECT track_id, CASE WHEN track_id % 4 IN (1, 2) THEN 'not ascending' WHEN track_id % 8 = 4 THEN 'required boundary left out'
WHEN track_id % 4 = 0 AND n > 2 AND n - 2 <= 3 THEN NULL ELSE 'not a path of allowed cues' END AS why FROM t WHERE n >= 1"""

    # ------------------------------------------------------------ files
    ms = "round_even({t} * 1000, 0)::BIGINT"
    stamp = lambda t: f"printf('%02d:%02d:%02d,%03d', {ms.format(t=t)} // 3600000, {ms.format(t=t)} // 60000 % 60, {ms.format(t=t)} // 1000 % 60, {ms.format(t=t)} % 1000)"
    ended = lambda body: f"SELECT track_id, regexp_replace({body}, '{SPACE}+$', '') || chr(10) AS text FROM cues GROUP BY track_id"
    out["s11_render_srt"] = f"WITH {q.CUES} " + ended(f"string_agg((seq + 1)::VARCHAR || chr(10) || {stamp('s')} || ' --> ' || {stamp('e')} || chr(10) || text || chr(10), chr(10) ORDER BY seq)")
    web = lambda t: f"printf('%02d:%02d:%06.3f', floor({t} / 3600)::BIGINT, floor(({t} % 3600) / 60)::BIGINT, ({t} % 60)::DOUBLE)"
    out["s10_render_vtt"] = f"WITH {q.CUES} " + ended(f"'WEBVTT' || chr(10) || chr(10) || string_agg({web('s')} || ' --> ' || {web('e')} || chr(10) || text || chr(10), chr(10) ORDER BY seq)")
    cs = "round_even({t} * 100, 0)::BIGINT"
    short = lambda t: f"printf('%d:%02d:%02d.%02d', {cs.format(t=t)} // 360000, {cs.format(t=t)} // 6000 % 60, {cs.format(t=t)} // 100 % 60, {cs.format(t=t)} % 100)"
    body = "replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '{}', '()'), '(?i)<i>', '{\\\\i1}', 'g'), '(?i)</i>', '{\\\\i0}', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), chr(10), '\\N')"
    head = ass_header().replace("'", "''")
    out["s12_render_ass"] = f"WITH {q.CUES} " + ended(f"'{head}' || string_agg('Dialogue: 0,' || {short('s')} || ',' || {short('e')} || ',Default,,0,0,0,,' || {body}, chr(10) ORDER BY seq)")
    out["s14_sound_tags"] = f"""WITH {q.TURNS}, u AS (SELECT track_id, seq, s, e, text, 0 AS side FROM turns UNION ALL SELECT track_id, NULL, s - 1, s, '[' || speaker || ']', 1 FROM turns WHERE seq % 2 = 1)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY s NULLS LAST, side, seq NULLS FIRST, e, text) - 1 AS seq, s AS "start", e AS "end", text, false AS lyric FROM u"""
    return out
