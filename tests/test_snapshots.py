import random
import unicodedata
from datetime import datetime, timedelta

import pytest

from lodestar.operators.snapshots import SnapshotIndex, snapshot_changes

SCHEMA = "snapshot_no int, source_id string, id string, title string, summary string, fetched_at timestamp"
T0 = datetime(2024, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    numbers = sorted({r[0] for r in rows})
    out = snapshot_changes(df, numbers, "snapshot_no", "source_id", "id", ["title", "summary"], "fetched_at").collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_kinds_of_change(spark):
    rows = [
        (1, "s", "a", "T", "x", T0), (1, "s", "b", "T", None, T0), (1, "s", "c", "T", "x", T0),
        (2, "s", " a\t", "T", "x ", T0), (2, "s", "b", "T", "", T0), (2, "s", "d", "T", "x", T0),
        (1, "r", "z", "T", "x", T0), (3, "r", "z", "T", "y", T0), (3, "s", "a", "T", "x", T0), (3, "s", "c", "T", "x", T0),
        (3, "q", "n", None, None, T0),
    ]
    assert run(spark, rows) == {(2, "d", "added"), (2, "c", "removed"), (3, "z", "changed"), (3, "b", "removed"), (3, "d", "removed"), (3, "c", "added")}


def test_latest_row_counts_and_notation_does_not(spark):
    late = T0 + timedelta(days=1)
    composed, apart = "café a b", unicodedata.normalize("NFD", "café  a b")
    rows = [(1, "s", "a", composed, "", T0), (2, "s", "a", "other", "", T0), (2, "s", "a", apart, None, late), (2, "s", None, "x", "x", T0)]
    assert run(spark, rows) == set()


def test_case_and_space_inside_words_count(spark):
    assert run(spark, [(1, "s", "a", "A b", "", T0), (2, "s", "a", "a b", "", T0)]) == {(2, "a", "changed")}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert snapshot_changes(df, [], "snapshot_no", "source_id", "id", ["title"], "fetched_at").count() == 0
    assert snapshot_changes(df, [1, 2], "snapshot_no", "source_id", "id", ["title"], "fetched_at").count() == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for n in range(1, 5):
        for s in "pqr":
            if rng.random() < 0.25:
                continue
            for k in range(12):
                for _ in range(rng.choice([0, 1, 1, 2])):
                    rows.append((n, s, f"{s}{k}", f"t{rng.randrange(2)}", rng.choice([None, "", "u"]), T0 + timedelta(seconds=rng.randrange(10**6))))
    expected, last = set(), {}
    for n in range(1, 5):
        for s in "pqr":
            mine = sorted((r for r in rows if r[0] == n and r[1] == s), key=lambda r: r[5])
            if not mine:
                continue
            now = {r[2]: (r[3], r[4] or "") for r in mine}
            if s in last:
                old = last[s]
                expected |= {(n, k, "added") for k in now.keys() - old.keys()} | {(n, k, "removed") for k in old.keys() - now.keys()} | {(n, k, "changed") for k in now.keys() & old.keys() if now[k] != old[k]}
            last[s] = now
    assert run(spark, rows) == expected


def test_old_values_are_fetched_for_changes_only(spark, tmp_path):
    one = spark.createDataFrame([(1, "s", "a", "T", "x", T0), (1, "s", "b", "T", "x", T0)], SCHEMA)
    two = spark.createDataFrame([(2, "s", "a", "U", "x", T0), (2, "s", "b", "T", "x", T0)], SCHEMA)
    index = SnapshotIndex(spark, str(tmp_path / "index"), "source_id", "id", ["title", "summary"], "fetched_at", buckets=2)
    index.apply(one)
    out = index.with_values(index.apply(two), one, two).collect()
    assert [(r["k"], r["title_old"], r["title_new"]) for r in out] == [("a", "T", "U")]
    plan = index.current._jdf.queryExecution().toString()
    assert "bucket" in plan.lower()


def test_index_is_opened_probed_and_swapped(spark, tmp_path):
    folder, fields = str(tmp_path / "index"), ["title", "summary"]

    def delivery(n, texts):
        return spark.createDataFrame([(n, "s", k, "T", v, T0) for k, v in texts.items()], SCHEMA)

    assert SnapshotIndex(spark, folder, "source_id", "id", fields, "fetched_at", buckets=2).apply(delivery(1, {"a": "x", "b": "x"})).count() == 0
    texts, seen = [{"a": "x", "b": "y"}, {"b": "y", "c": "z"}, {"a": "x"}], []
    for n, t in enumerate(texts):
        opened = SnapshotIndex(spark, folder, "source_id", "id", fields, "fetched_at")
        assert opened.generation == n + 1 and opened.buckets == 2
        seen.append({(r["k"], r["change_kind"]) for r in opened.apply(delivery(n + 2, t)).collect()})
    assert seen == [{("b", "changed")}, {("a", "removed"), ("c", "added")}, {("a", "added"), ("b", "removed"), ("c", "removed")}]
    assert sorted(p.name for p in (tmp_path / "index").glob("generation-*")) == ["generation-3", "generation-4"]
    assert {r["k"] for r in opened.current.collect()} == {"a"}
    with pytest.raises(ValueError):
        SnapshotIndex(spark, folder, "source_id", "id", ["title"], "fetched_at")


def test_probe_does_not_shuffle_the_index(spark, tmp_path):
    df = spark.createDataFrame([(n, "s", f"k{i}", "T", str(i % (n + 1)), T0) for n in (1, 2) for i in range(50)], SCHEMA)
    index = SnapshotIndex(spark, str(tmp_path / "index"), "source_id", "id", ["title", "summary"], "fetched_at", buckets=2)
    rows = index.bucketed(df, "snapshot_no")
    index.apply_hashed(rows.where("snapshot_no = 1"))
    joined = index.current.join(rows.where("snapshot_no = 2").select("g", "k", "h"), ["g", "k"], "full_outer")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
