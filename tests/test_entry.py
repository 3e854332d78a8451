import importlib
import os

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
CORE = {n: q for m in driver._MODULES for n, q in importlib.import_module(m).QUERIES.items()}
SQL = {n: s for m in driver._MODULES for n, s in importlib.import_module(m).SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


def test_names_are_registered():
    assert set(SQL) <= set(CORE) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        pq.write_table(pq.read_table(f"{DATA}/{f}").slice(0, 0), f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_on_empty_tables(spark, empty, name):
    CORE[name](spark, empty).collect()


def test_nothing_outside_needs_the_text_package():
    for folder, _, files in os.walk(os.path.join(os.path.dirname(driver.__file__), "lodestar")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, f)) as source:
                    assert "lodestar.llm" not in source.read(), f
