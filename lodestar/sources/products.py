"""Product collections held as JSON lists or objects, and pages cut into headed sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import clean_space, keywords_of, slug, stable_id
from lodestar.operators.maintenance import richest_per_key

# Field names under which collections hold the same thing, first one first. Fixed values.
ALIASES = {
    "title": ["Product Name", "product_name", "name"], "summary": ["Product Description", "product_description", "description"],
    "institute": ["Company Name", "company_name", "company"], "programme": ["Programme", "program"], "category": ["Category", "category"],
}


def product_records(df: DataFrame, key: str, payload: str, base_url: str) -> DataFrame:
    """Records of collections held as JSON in a column, contact fields left out.

    A collection is a list or an object of products; anything else gives no rows, nor do
    products without title, summary or company. Of one (title, company) the longest
    summary is kept. Only listed fields are read, so personal data never leaves the source.
    """
    return _records(_exploded(df, key, payload), key, base_url)


def _exploded(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, source_key, product) of lists and objects alike."""
    listed = F.from_json(F.col(payload), "array<string>")
    named = F.from_json(F.col(payload), "map<string,string>")
    is_list = F.trim(F.col(payload)).startswith("[")
    entries = F.when(is_list, F.transform(listed, lambda v, i: F.struct(i.cast("string").alias("source_key"), v.alias("product")))).otherwise(
        F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("source_key"), e["value"].alias("product")))
    )
    return df.select(key, F.posexplode(entries).alias("pos", "x")).select(key, "pos", "x.source_key", "x.product")


def _records(products: DataFrame, key: str, base_url: str) -> DataFrame:
    def field(name: str) -> Column:
        found = [F.nullif(clean_space(F.coalesce(F.get_json_object("product", f"$['{a}']"), F.lit(""))), F.lit("")) for a in ALIASES[name]]
        return F.coalesce(*found, F.lit(""))

    rows = products.select(key, "pos", "source_key", *[field(n).alias(n) for n in ALIASES]).where((F.col("title") != "") & (F.col("summary") != "") & (F.col("institute") != ""))
    rows = rows.withColumns({"__t": F.lower("title"), "__c": F.lower("institute")})
    kept = richest_per_key(rows, [key, "__t", "__c"], "summary", "pos", ["title", "summary", "institute", "programme", "category", "source_key"])
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.replace(F.url_encode("source_key"), F.lit("+"), F.lit("%20")))
    return kept.select(key, stable_id("product_", F.concat_ws("|", "title", "institute")).alias("id"), "title", "summary", "institute", "programme", F.col("category").alias("sector"), keywords_of(F.col("title"), 3, 10).alias("keywords"), url.alias("url"))


def sectioned_pages(elements: DataFrame, key: str, heading: str = "h2", least_title: int = 4, most_parts: int = 4) -> DataFrame:
    """(key, section, title, summary): sections of pages, each a heading with the first paragraphs under it; of one title the first section."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = elements.where(F.col("tag").isin(heading, "p", "li")).withColumn("section", F.count(F.when(F.col("tag") == heading, 1)).over(w)).where(F.col("section") > 0)
    parts = F.array_sort(F.collect_list(F.when((F.col("tag") != heading) & (F.length("text") > 10), F.struct("ord", "text"))))
    title = F.max(F.when(F.col("tag") == heading, F.col("text")))
    built = numbered.groupBy(key, "section").agg(title.alias("title"), F.array_join(F.slice(F.transform(parts, lambda x: x["text"]), 1, most_parts), " ").alias("summary"))
    kept = built.where(F.length("title") >= least_title).withColumn("__slug", slug(F.col("title")))
    first = kept.groupBy(key, "__slug").agg(F.min_by(F.struct("section", "title", "summary"), "section").alias("x"))
    return first.select(key, "x.section", "x.title", "x.summary")


def listing_titles(elements: DataFrame, page: str, id_pattern: str, heading: str = "h5") -> DataFrame:
    """(id, title): the heading inside each listing link, by the id in its address; the latest page wins."""
    linked = elements.where(F.col("tag").isin("a", heading)).withColumn("__id", F.regexp_extract("href", id_pattern, 1))
    w = Window.partitionBy(page).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    headed = linked.withColumn("__link", F.first(F.when(F.col("tag") == "a", F.col("__id")), ignorenulls=True).over(w)).where((F.col("tag") == heading) & (F.length("__link") > 0))
    return headed.groupBy(F.col("__link").alias("id")).agg(F.max_by(F.col("text"), F.struct(F.col(page), -F.col("ord"))).alias("title"))
