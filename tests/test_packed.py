import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.operators.packed import MAX_ENTRIES, split_packed

ENTRIES = ["Code/Platforms", "Data, Networks and Apps", "Plant / House / Body Care", "Metals"]


def values(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, field string")
    out = split_packed(df, "field", ENTRIES, **options).orderBy("id", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append(r["value"])
        assert r["pos"] == len(got[r["id"]])
    return got


@pytest.mark.parametrize("packed, expected", [
    ("Metals; Farming;;Edibles ;", ["Metals", "Farming", "Edibles"]),
    ("Code/Platforms/Metals", ["Code/Platforms", "Metals"]),
    ("Data, Networks and Apps, Metals", ["Data, Networks and Apps", "Metals"]),
    ("Data\\, Networks and Apps, Metals", ["Data, Networks and Apps", "Metals"]),
    ("Plant / House / Body Care / Farming", ["Plant / House / Body Care", "Farming"]),
    ('"A, B", C', ["A, B", "C"]),
    ('["A; B", "C"]', ["A; B", "C"]),
    ("'A';'B/C'", ["A", "B/C"]),
    ("- A\n• B\n2) C", ["A", "B", "C"]),
    ("A<br/> B<br>C", ["A", "B", "C"]),
    ("A，B、C；D｜E", ["A", "B", "C", "D", "E"]),
    ("  A  ", ["A"]),
    ("it's; rock 'n' roll", ["it's", "rock 'n' roll"]),
    ("A0; B", ["A0", "B"]),
    ("A;A", ["A", "A"]),
    ('say ""x""; y', ['say ""x""', "y"]),
])
def test_each_notation(spark, packed, expected):
    assert values(spark, [("x", packed)])["x"] == expected


def test_nothing_in_nothing_out(spark):
    assert values(spark, [("a", None), ("b", ""), ("c", " ; ,, "), ("d", "\n")]) == {}
    assert split_packed(spark.createDataFrame([], "id string, field string"), "field").count() == 0


def test_long_field_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([("x", ";".join(f"v{i}" for i in range(5000)), 7, "old")] * 2, "id string, field string, pos int, extra string")
    out = split_packed(df, "field")
    assert out.count() == 10_000 and "extra" in out.columns and out.agg({"pos": "max"}).first()[0] == 5000


def test_blank_separates_codes(spark):
    assert values(spark, [("x", "35 65  07.080")], blank_separates=True)["x"] == ["35", "65", "07.080"]


def test_too_many_entries():
    with pytest.raises(ValueError):
        split_packed(None, "f", ["a/b"] * (MAX_ENTRIES + 1))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abc d/,;'é名", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoted_values_round_trip(spark, parts):
    packed = "; ".join('"' + p.replace("\\", "\\\\").replace('"', '\\"') + '"' for p in parts)
    assert values(spark, [("x", packed)])["x"] == parts
