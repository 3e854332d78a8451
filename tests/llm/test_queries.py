"""Every query over the smallest tables, and over empty ones."""

import os

import pyarrow.parquet as pq
import pytest

from lodestar.llm.queries import QUERIES

COLUMNS = {
    "p2_found": "rec_table string, rec_key string, seg_no int, lang string", "p3_found": "id string", "p4_found": "id string, field string", "p6_found": "rec_table string, rec_key string, ics_code string",
    "p7_found": "name_a string, name_b string", "p8_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, start_char int, end_char int",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_distinct_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        rows = df.collect()
        assert len(rows) == len(set(rows)) > 0


@pytest.mark.parametrize("name, tables", [("p2_segments", {"documents", "technology", "snapshot_record"}), ("p6_composition", {"documents", "technology"})])
def test_all_tables_enter(spark, data, name, tables):
    rows = QUERIES[name](spark, data).collect()
    assert {r["rec_table"] for r in rows} == tables
    if name == "p6_composition":
        found = [(r["rec_table"], r["ics_code"]) for r in QUERIES["p6_found"](spark, data).collect()]
        assert {(r["rec_table"], r["ics_code"]): r["n_docs"] for r in rows} == {k: found.count(k) for k in found}


@pytest.fixture(scope="module")
def empty(tmp_path_factory, data):
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(data):
        pq.write_table(pq.read_table(f"{data}/{f}").slice(0, 0), f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
