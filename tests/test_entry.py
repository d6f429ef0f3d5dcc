"""The driver's contract: names, schemas, and rows against SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from cuegrid.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["i1_windows_to_spans", "i2_coalesce_spans", "i4_subtract_spans", "i14_fit_events", "j1_interval_anti_join", "j4_dominant_overlap", "j10_snap_to_silence", "f6_fill_inserted", "f14_prompt_windows", "x7_strip_punctuation", "t1_polish_timing", "x31_fix_gate"]
CHEAP += ["q2_text_atoms", "s4_decoded_texts", "s6_sniffed_formats", "s8_document_cues", "s16_shot_times", "s19_picked_media", "s20_language_of_path", "x30_parsed_replies", "m_failed_tracks", "f1_pack_segments", "f4_min_duration", "f15_windows_of_forty", "t4_snap_to_shots", "b7_path_options"]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@needs_tables
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["lang"] for r in rows} >= {"en", "de"} and all(r["n"] > 0 for r in rows)


def rounded(rows):
    out = []
    for r in rows:
        out.append(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@needs_tables
@pytest.mark.parametrize("name", CHEAP)
def test_rows_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded(map(tuple, got.select(*want.columns).collect())) == rounded(want.fetchall())
