import json

from pyspark.sql import functions as F

from lodestar.sources import html, products
from lodestar.streaming import index


def test_lists_objects_aliases_and_personal_data(spark):
    rows = [
        ("l", json.dumps([{"Product Name": " A  b ", "Product Description": "long text", "Company Name": "C", "Business Email": "x@y"}, {"name": "a B", "description": "longer text", "company": "c"}, 5, {"name": "no text"}])),
        ("o", json.dumps({"k/1": {"product_name": "Z", "product_description": "d", "company_name": "C", "Category": "Food"}})),
        ("s", '"text"'), ("n", None), ("b", "broken"), ("e", "[]"),
    ]
    got = {(r["page"], r["title"], r["summary"], r["url"]) for r in products.product_records(spark.createDataFrame(rows, "page string, p string"), "page", "p", "https://s").collect()}
    assert got == {("l", "a B", "longer text", "https://s/1"), ("o", "Z", "d", "https://s/k%2F1")}


def test_sections_and_listing_titles(spark):
    page = "<p>before</p><h2>One thing</h2><p>tiny</p><p>A first paragraph.</p><li>A second paragraph.</li><h2>ab</h2><p>under a short title</p><h2>One  thing</h2><p>Another paragraph.</p>"
    e = html.page_elements(spark.createDataFrame([("p", page), ("q", None)], "k string, h string"), "k", "h")
    assert [(r["title"], r["summary"]) for r in products.sectioned_pages(e, "k").collect()] == [("One thing", "A first paragraph. A second paragraph.")]
    lists = [(1, "<a href='/t/7'><h5>Old</h5></a><a href='/t/8'><h5>Eight</h5></a>"), (2, "<a href='/t/7'><h5>New</h5></a><a href='/x'><h5>None</h5></a>")]
    e = html.page_elements(spark.createDataFrame(lists, "page int, h string"), "page", "h", "https://s/")
    assert {(r["id"], r["title"]) for r in products.listing_titles(e, "page", r"/t/(\d+)").collect()} == {("7", "New"), ("8", "Eight")}


def test_index_builds_only_what_changed(spark, tmp_path):
    schema = "id string, version int, title string"
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "y"), ("a", 0, "old")], [("a", 2, "x"), ("b", 2, "z"), ("c", 2, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    built = []

    def build(rows):
        built.append(sorted(r["id"] for r in rows.collect()))
        return rows.withColumn("n", F.length(F.coalesce("title", F.lit(""))))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = index.maintained_index(index.content_versions(stream, "id", "version", "title"), "id", "version", "digest", build)
    assert sorted((r["id"], r["title"], r["n"]) for r in out.collect()) == [("a", "x", 1), ("b", "z", 1), ("c", None, 0)]
    assert built == [["a", "b"], ["b", "c"]] or built == [["a", "b", "c"]]
