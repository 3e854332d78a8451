import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.sources import dimensions, feeds, html, paged, snapshots
from lodestar.streaming import topics


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"id": "1", "title": "T", "odd": 1}, {"id": "2", "keywords": ["x"]}]), "utf-8")
    (tmp_path / "a_staging.json").write_text("[]")
    rows = snapshots.read_snapshot(spark, str(tmp_path / "a.json"))
    assert [(r["id"], r["title"], r["keywords"]) for r in rows.orderBy("id").collect()] == [("1", "T", None), ("2", None, ["x"])]
    assert snapshots.read_snapshot(spark, str(tmp_path / "none.json")).count() == 0
    assert snapshots.read_published(spark, str(tmp_path / "*.json")).select("file_name").distinct().count() == 1
    assert snapshots.read_with_fallback(spark, str(tmp_path / "none.json"), str(tmp_path / "a.json")).count() == 2


def test_guarded_publication(spark, tmp_path):
    df, target = spark.range(3), str(tmp_path / "live")
    with pytest.raises(ValueError):
        snapshots.publish(df, target, ["too few rows"])
    with pytest.raises(PermissionError):
        snapshots.publish(df, target, [], production=target)
    snapshots.publish(df, target, [], production=target, allow_production=True)
    snapshots.publish(spark.range(5), target, [])
    assert spark.read.parquet(target).count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_xml_items(spark):
    df = spark.createDataFrame([("<item><stechNum>7</stechNum><techName> Pump </techName><keyword>a;b</keyword><appFld>c</appFld><regDate>20240131</regDate></item>",), ("<item></item>",), (None,)], "x string")
    got = feeds.xml_items(df, "x").collect()
    assert (got[0]["title"], got[0]["keywords"], got[0]["reg_date"], got[0]["sector"]) == ("Pump", ["a", "b", "c"], "2024-01-31", "Uncategorized")
    assert got[1]["title"] == got[2]["title"] == "Untitled" and got[2]["keywords"] == []


def test_nodes_drop_unpublished_and_resolve_references(spark):
    v = lambda x: [{"value": x}]
    rows = [{"nid": v(1), "status": v("1"), "title": v("A"), "path": [{"alias": "/a"}], "countries": [{"target_id": 2}, {"target_id": "q"}, {"target_id": 1}, {"target_id": 2}]}, {"nid": v(2), "status": v(False), "title": v("B")}, {"nid": v(3), "status": v(True), "title": v("  ")}, {"nid": v(4), "status": v(True), "title": v("D")}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",)], "j string")
    names = spark.createDataFrame([(1, "One"), (2, "Two")], "tid int, name string")
    got = {r["id"]: (r["countries"], r["url"]) for r in feeds.nodes(df, "j", names, "https://n").collect()}
    assert got == {"node_1": (["Two", "One"], "https://n/a"), "node_4": (["Unspecified"], "https://n/node/4")}


def test_html_records(spark):
    page = "<h2>Food</h2><table><tr><th>Status:</th><td>open</td></tr><tr><td>1</td><td>2<br>3</td><td>4</td></tr></table><a href='/x.pdf'>X</a><a href='/x.pdf'>again</a>"
    e = html.page_elements(spark.createDataFrame([("p", page), ("q", None), ("r", "<td>unclosed")], "k string, h string"), "k", "h", "https://s/")
    assert [r["cells"] for r in html.table_rows(e, "k").collect()] == [["1", "23", "4"]]
    assert ("status", "open") in {(r["name"], r["value"]) for r in html.key_values(e, "k").collect()}
    assert [(r["category"], r["text"], r["href"]) for r in html.headed_links(e, "k", ".pdf").collect()] == [("Food", "X", "https://s/x.pdf")]


def test_paged_source_first_id_wins_and_filters_are_pushed(spark, tmp_path):
    for n, rows in enumerate([[{"id": 1, "kind": "a"}, {"id": 2, "kind": "b"}, "bad"], [{"id": 1, "kind": "b"}, {"id": 3, "kind": "b"}]]):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
    df = paged.read_paged(spark, str(tmp_path / "{page}.json"), pages="5", fields="kind", parameters="kind")
    assert sorted((r["id"], r["kind"]) for r in df.collect()) == [("1", "a"), ("2", "b"), ("3", "b")]
    raw = spark.read.format("paged").options(path=str(tmp_path / "{page}.json"), pages="5", fields="kind", parameters="kind").load()
    assert raw.where("kind = 'b'").count() == 3


def test_dimension_checks(spark, tmp_path):
    known = spark.createDataFrame([("27",), ("31",)], "code string")
    (tmp_path / "m.csv").write_text('ntb_code,ntb_label,ics_codes,preferred_query_for\nA,x,"27;31",27\nB,y,,\n')
    got = {r["ntb_code"]: (r["codes"], r["preferred"]) for r in dimensions.read_code_mapping(spark, str(tmp_path / "m.csv"), known).collect()}
    assert got == {"A": (["27", "31"], "27"), "B": ([], None)}
    (tmp_path / "n.csv").write_text("ntb_code,ntb_label,ics_codes,preferred_query_for\nA,x,99,\n")
    with pytest.raises(ValueError):
        dimensions.read_code_mapping(spark, str(tmp_path / "n.csv"), known)
    (tmp_path / "o.csv").write_text("id,sector_code,reason\na,27,r\n,27,r\n")
    with pytest.raises(ValueError):
        dimensions.read_overrides(spark, str(tmp_path / "o.csv"), {"27"})


def test_exact_limiter_ignores_rejected_hits(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    offsets = [0, 10, 20, 30, 60, 61, 70, 71]
    df = spark.createDataFrame([(i, t0 + timedelta(seconds=s), 1) for i, s in enumerate(offsets)], "event_id long, ts timestamp_ntz, user_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = topics.drained(topics.rate_limited(topics.event_stream(spark, str(tmp_path / "e"), df.schema), limit=2, seconds=60), "limited")
    granted, expected = {r["event_id"]: r["granted"] for r in out.collect()}, {}
    held = []
    for i, s in enumerate(offsets):
        held = [h for h in held if h >= s - 60]
        expected[i] = len(held) < 2
        if expected[i]:
            held.append(s)
    assert granted == expected


def test_daily_topics_stream_equals_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    batch = events.groupBy("event_type", F.to_date("ts").alias("day")).count()
    stream = topics.drained(topics.daily_topics(topics.event_stream(spark, f"{data}/event[s].parquet", events.schema)), "topics", "complete")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
