import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.functions.vectors import cosine, l2_normalised
from lodestar.operators import facets, federation, maintenance, search, taxonomy
from lodestar.operators.records import latest_per_key


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_latest_per_key_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 2, None), ("b", None, None)], "k string, v int, w string")
    assert {tuple(r) for r in latest_per_key(df, ["k"], ["v"], ["w"]).collect()} == {("a", "y"), (None, None), ("b", None)}


@pytest.mark.parametrize("raw, code", [("genome and medical drug", ["07.080", "11"]), ("robot", ["25"]), ("solar sensor software glass", ["27", "31", "35"]), ("none", []), (None, [])])
def test_keyword_rules_in_order(spark, raw, code):
    assert one(spark, taxonomy.keyword_codes, raw) == code


def test_substring_rules_match_inside_words(spark):
    assert one(spark, taxonomy.keyword_codes, "biotech") == ["07.080", "35"]


def test_classification_falls_back(spark):
    mapping = spark.createDataFrame([("Farming", ["65"]), ("Misc", [])], "source_sector string, ics_codes array<string>")
    df = spark.createDataFrame([("1", " farming ", "x"), ("2", "Misc", "solar"), ("3", "materials", "steel"), ("4", None, "x")], "id string, s string, t string")
    got = {r["id"]: (r["codes"], r["method"], r["confidence"]) for r in taxonomy.classified(df, "s", taxonomy.keyword_codes(F.col("t")), mapping).collect()}
    assert got == {"1": (["65"], "source_mapping", "high"), "2": (["27"], "keyword_fallback", "low"), "3": (["77"], "keyword_mapping", "medium"), "4": ([], "unclassified", "low")}


def test_explicit_codes_take_precedence(spark):
    df = spark.createDataFrame([(["07.080", "07.080", "zz"], "27"), ([], "07.080"), (None, "27"), (None, "other"), (None, None)], "l array<string>, o string")
    found = taxonomy.explicit_first(F.col("l"), F.col("o"), F.lit(None).cast("string"), F.lit("odd"), F.array(F.lit("11")))
    got = [(r[0], r[1], r[2]) for r in df.select(found["codes"], found["method"], found["confidence"]).collect()]
    assert got == [(["07.080"], "indexed_sector_codes", "low"), (["11"], "keyword_fallback", "low"), (["27"], "indexed_sector_code", "low"), ([], "indexed_unclassified", "low"), (["11"], "keyword_fallback", "low")]


def test_sector_selection(spark):
    df = spark.createDataFrame([(["07.080"],), (["08"],), ([],), (None,)], "c array<string>")
    hits = lambda sel: [r[0] for r in df.select(taxonomy.matches_sectors(F.col("c"), sel)).collect()]
    assert hits(["07"]) == [True, False, False, False] and hits(["other"]) == [False, False, True, True] and hits([]) == [True] * 4


def test_hybrid_score(spark):
    df = spark.createDataFrame([("solar pump", "a solar pump", [0.8, 0.6]), ("x", "wind farm", [0.0, 1.0]), ("y", "nothing", None)], "t string, b string, v array<float>")
    got = search.scored(df, F.col("t"), F.col("b"), " Solar  Pump", ["wind", "farm"], F.col("v"), [1.0, 0.0]).collect()
    assert [r["matches"] for r in got] == [True, True, False]
    assert [round(r["score"], 4) for r in got] == [0.83, 0.1, 0.0]
    blank = search.scored(df, F.col("t"), F.col("b"), "  ", [], None, None).collect()
    assert all(r["matches"] and r["score"] == 0 for r in blank)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(cosine(l2_normalised(F.col("a")), F.col("b"))).collect()
    assert [round(r[0], 6) for r in got] == [0.6, 0.0, 0.0, 0.0]


def test_page_plan_matches_brute_force():
    for totals in ([("a", 7), ("b", 0), ("c", 3)], [("a", 50)], [], [("a", None), ("a", 5), ("b", -1)], [("a", 4), ("b", 41), ("c", 4)]):
        counts = {}
        for s, n in totals:
            counts.setdefault(s, n if isinstance(n, int) and n > 0 else 0)
        every = [(s, i) for i in range(max(counts.values(), default=0)) for s in counts if counts[s] > i]
        for page in (0, 1, 2, 3, 99):
            pages, at, refs = search.page_plan(totals, page, 5)
            assert pages == max(1, math.ceil(len(every) / 5)) and at == min(max(1, page), pages)
            assert refs == every[(at - 1) * 5 : at * 5]


def test_interleaving_equals_a_sort(spark):
    rows = [("a", f"{i:03}") for i in range(60)] + [("b", f"{i:03}") for i in range(7)] + [("c", "000")]
    df = spark.createDataFrame(rows, "s string, id string")
    ordinals = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "s string, o int")
    got = [(r["s"], r["id"]) for r in sorted(search.interleaved(df, "s", ["id"], ordinals, "o").collect(), key=lambda r: r["pos"])]
    place = {"c": 0, "a": 1, "b": 2}
    by = {s: [r for r in rows if r[0] == s] for s in place}
    assert got == [r for _, _, r in sorted((i, place[s], r) for s, rs in by.items() for i, r in enumerate(rs))]


def test_blocked_similarity(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None)], "id long, v array<float>")
    got = search.blocked_similarity(v.where("id = 2"), v, "id", "id", "v", top=2, block_rows=4).orderBy("r").collect()
    assert [(r["q"], r["r"], r["similarity"]) for r in got] == [(2, 2, 5.0), (2, 5, 5.0)]
    assert search.blocked_similarity(v.where("id = 2"), v.where("id < 0"), "id", "id", "v", least=0.1).count() == 0


def test_facets_do_not_filter_themselves(spark):
    df = spark.createDataFrame([("1", "a", ["X", "Y"], ["07.080"]), ("2", "b", ["X"], []), ("3", "a", [], ["27", "27.010"])], "id string, s string, c array<string>, k array<string>")
    args = (F.col("id"), F.lit(True), F.col("s"), F.col("c"), F.col("k"), taxonomy.top_level(F.col("k")))
    got = {(r["facet"], r["value"]): r["n"] for r in facets.facet_counts(df, *args, ["a"], [], []).collect()}
    assert got == {("source", "a"): 2, ("source", "b"): 1, ("country", "X"): 1, ("country", "Y"): 1, ("sector", "07"): 1, ("sector", "27"): 1}
    got = {(r["facet"], r["value"]): r["n"] for r in facets.facet_counts(df, *args, [], ["Y"], ["27"]).collect()}
    assert got == {("country", "X"): 0} or got == {("sector", "07"): 1}


def test_unknown_count_differs_from_zero(spark):
    counts = spark.createDataFrame([("a", 3)], "value string, n long")
    domain = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "value string, available boolean")
    assert {r[0]: r[1] for r in facets.filled_facets(counts, domain).collect()} == {"a": 3, "b": 0, "c": None}


def test_source_pruning(spark):
    s = spark.createDataFrame([("a", "Global", False, True, "Licence"), ("b", "India", None, None, None), ("c", "Fiji", True, False, "")], "id string, country string, multi_country boolean, sector_filter_supported boolean, transfer_type string")
    ids = lambda **k: sorted(r["id"] for r in federation.pruned_sources(s, **k).collect())
    assert ids(countries=["India"]) == ["a", "b", "c"] and ids(countries=["Peru"]) == ["a", "c"]
    assert ids(sectors=["27"]) == ["a"] and ids(transfer_types=["", "Licence"]) == ["a"] and ids(include=["a", "b"], exclude=["b"]) == ["a"]


def test_validation_messages(spark):
    df = spark.createDataFrame([("s", "1", "t", "https://x/1"), ("s", "1", "", "ftp://x"), ("s", None, "t", None)], "g string, id string, t string, u string")
    before = spark.createDataFrame([("s", 4)], "g string, n_rows long")
    r = maintenance.validated(df, "g", "id", "t", "u", 5, before).first()
    assert r["errors"] == "too few rows; missing ids; missing titles; missing urls; invalid urls; duplicate ids"
    r = maintenance.validated(df, "g", "id", "t", "u", 1, spark.createDataFrame([("s", 5)], "g string, n_rows long")).first()
    assert r["errors"].endswith("row count dropped")


def test_pending_and_upsert(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "id string, h string, v int")
    new = spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "1", 2)], "id string, h string, v int")
    assert sorted(r["id"] for r in maintenance.pending(new, old, "id", "h").collect()) == ["b", "c"]
    assert sorted((r["id"], r["v"]) for r in maintenance.upserted(old, new, ["id"], "v").collect()) == [("a", 2), ("b", 2), ("c", 2)]


def test_richest_wins(spark):
    df = spark.createDataFrame([("k", "aa", 1), ("k", "aaa", 2), ("k", "bbb", 3), ("j", None, 4)], "k string, t string, o int")
    assert {r["o"] for r in maintenance.richest_per_key(df, ["k"], "t", "o", ["o"]).collect()} == {2, 4}


@pytest.mark.parametrize("raw, label", [("trl_8_system_complete", "TRL 8 — System complete"), ("in_use now", "In Use Now"), ("", "")])
def test_trl_label(spark, raw, label):
    assert one(spark, text.trl_label, raw) == label


def test_text_functions(spark):
    assert one(spark, text.iso_date, "20240131") == "2024-01-31" and one(spark, text.iso_date, "31.1.") == "31.1."
    assert one(spark, text.slug, "--A b/C!") == "a_b_c"
    assert one(spark, text.html_escaped, "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, text.normalised_exact, "  Ａ  ﬁ ") == "a fi" and one(spark, text.normalised_exact, None) == ""
    assert one(spark, text.repaired_encoding, "caf√©") == "café" and one(spark, text.repaired_encoding, "naïve") == "naïve"
    assert one(spark, text.csv_values, "a, ,b,") == ["a", "b"] and one(spark, text.initials, "the Great Old Library") == "GL"
    assert one(spark, text.is_sensitive, "call +66 2 123 4567 8") and not one(spark, text.is_sensitive, "pump 2000")
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("x", "9.9.9.9"), (None, "nobody")], "f string, p string")
    assert [r[0] for r in df.select(text.client_address("f", "p")).collect()] == ["2.2.2.2", "9.9.9.9", "unknown"]


def test_translation_status(spark):
    df = spark.createDataFrame([("ไทย", "Thai", 200, None), ("a", "A ", 200, ""), ("a", "MYMEMORY WARNING: x", 200, ""), ("a", "b", 429, ""), ("a", "b", 500, ""), ("a", None, None, None)], "o string, t string, s int, d string")
    assert [r[0] for r in df.select(text.translation_status(F.col("o"), F.col("t"), F.col("s"), F.col("d"))).collect()] == ["translated", "original_preserved", "quota_exceeded", "quota_exceeded", "api_error", "original_preserved"]
