"""Registered queries against their SQL, and the entry module with and without its optional part."""

import os
import subprocess
import sys

import duckdb
import pytest

from hearthline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["k7_configuration_table", "n7_weekly_and_total", "m3_attach_tenancies", "v13_document", "q1_completeness", "j3_queue_order", "l4_anchors", "c3_c4_packing", "h6_definitions", "f2_question_lines", "e2_long_rows", "r9_counts_by_hour", "x_fragment_bodies", "x9_x14_widgets", "x_html_fragments", "l8_frontier", "v9_node2", "v11_node4", "k6_diff_report", "k12_known_sites", "h2_places", "f6_policy_snippets", "j10_newest_kept", "r2_job_states", "e5_format_dispatch", "q2_presence"]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{float(r[i]):.6g}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['hearthline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
