"""Enrichment, presentation, product and index queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import taxonomy
from lodestar.operators.search import distributed_positions
from lodestar.plans.catalogue import CAT, catalogue
from lodestar.sources import html, products
from lodestar.storage import table
from lodestar.streaming import index

BATCH = 5
SELECTED = ["27", "35"]


def redirect_links(spark: SparkSession, d: str) -> DataFrame:
    """A redirecting source has no rows of its own; its link carries the encoded query."""
    return table(spark, d, "catalogue_source").where(F.length("url") > 0).select("id", F.concat("url", F.lit("search?q="), F.replace(F.url_encode(F.lit("solar & wind 5%")), F.lit("+"), F.lit("%20"))).alias("link"))


def sources_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Sources by size, unknown sizes last, registration order on ties."""
    per = catalogue(spark, d, ["source_id"]).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ranked = table(spark, d, "catalogue_source").select("id").join(per, "id", "left")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc_nulls_last(), "id"))).select("id", "n", "rank")


def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with a review before the model's answer, label and method to match, keywords made anew."""
    reviews = table(spark, d, "sector_override").groupBy("id").agg(F.min(F.struct("sector_code", "reason")).alias("r"))
    cat = catalogue(spark, d, ["title", "sector_codes"]).join(reviews, "id", "left")
    answer = F.coalesce(F.get("sector_codes", F.lit(0)), F.lit(taxonomy.OTHER))
    code = F.coalesce("r.sector_code", answer)
    label = F.coalesce(F.get(taxonomy.labels_of(taxonomy.known_codes(F.array(code))), F.lit(0)), F.lit(""))
    return cat.select("id", code.alias("sector_code"), label.alias("sector"), F.when(F.col("r").isNotNull(), "reviewed_override").otherwise("model_structured").alias("method"), F.when(F.col("r").isNotNull(), "high").otherwise("medium").alias("confidence"), F.array_join(text.keywords_of(F.col("title"), 3, 10), "|").alias("words"))


def request_batches(spark: SparkSession, d: str) -> DataFrame:
    """Records grouped into requests of five, numbered per source, with the ids each must answer."""
    placed = distributed_positions(catalogue(spark, d, ["source_id"]).where(F.col("source_id").isNotNull()).select("id", "source_id"), ["source_id"], ["id"], "loc")
    grouped = placed.groupBy("source_id", F.floor(F.col("loc") / BATCH).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select("source_id", "batch", F.array_join("ids", ",").alias("ids"))


def response_order(spark: SparkSession, d: str) -> DataFrame:
    """Answers put back into the order of the request; ids asked but not answered, and the reverse, show as null."""
    asked = table(spark, d, "documents").where(F.col("doc_id") % 3 != 0).select("doc_id", F.lit(True).alias("asked"))
    answered = table(spark, d, "documents").where(F.col("doc_id") % 5 != 0).select("doc_id", F.lit(True).alias("answered"))
    return asked.join(answered, "doc_id", "full_outer").groupBy(F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("answered", F.lit(False)).alias("answered")).agg(F.count(F.lit(1)).alias("n"))


def flag_sources(spark: SparkSession, d: str) -> DataFrame:
    """For every country of the catalogue the first registered source of that country."""
    first = table(spark, d, "catalogue_source").where(F.length("country") > 0).groupBy("country").agg(F.min("id").alias("flag_source"))
    seen = catalogue(spark, d, ["country"]).where(F.length("country") > 0).select("country").distinct()
    return seen.join(first, "country", "left")


def display_cards(spark: SparkSession, d: str) -> DataFrame:
    """What a card shows: the selected sector's label, how many more, the date in words, escaped title."""
    cat = catalogue(spark, d, ["title", "sector", "sector_codes", "sector_labels", "reg_date", "org_name"])
    codes = F.coalesce("sector_codes", F.array().cast("array<string>"))
    labels = F.coalesce("sector_labels", F.array().cast("array<string>"))
    place = F.transform(codes, lambda c, i: F.when(c.isin(*SELECTED) | F.greatest(*[c.startswith(s + ".") for s in SELECTED]), i))
    chosen = F.coalesce(F.get(F.array_compact(place), F.lit(0)), F.lit(0))
    label = F.coalesce(F.get(labels, chosen), "sector", F.lit(""))
    more = F.greatest(F.size(labels) - 1, F.lit(0))
    date = F.when(F.col("reg_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(F.col("reg_date"), "yyyy-MM-dd"), "d MMM yyyy")).otherwise("")
    return cat.select("id", F.concat(text.html_escaped(label), F.when((more > 0) & (label != ""), F.concat(F.lit(" +"), more.cast("string"))).otherwise("")).alias("sector"), F.coalesce(date, F.lit("")).alias("shown_date"), F.coalesce(text.html_escaped(F.col("title")), F.lit("")).alias("title"))


def title_from_address(spark: SparkSession, d: str) -> DataFrame:
    """Titles made from the last part of an address."""
    part = F.regexp_extract("url", r"([^/]+)/?$", 1)
    return catalogue(spark, d, ["url"]).where(F.length("url") > 0).select("id", F.initcap(F.regexp_replace(part, "[-_]+", " ")).alias("title"))


def catalogue_order(spark: SparkSession, d: str) -> DataFrame:
    """All records with their place in catalogue order, found by ranges, not in one task."""
    cat = catalogue(spark, d, ["title", "org_name"])
    keyed = cat.select("id", F.lit(1).alias("all"), F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("org_name", F.lit(""))).alias("o"))
    return distributed_positions(keyed, ["all"], ["t", "o", "id"], "place").select("id", "place")


def readiness_levels(spark: SparkSession, d: str) -> DataFrame:
    """Readiness level named in a text, 0 where none is."""
    level = F.coalesce(F.nullif(F.regexp_extract("text", r"TRL\s*(\d)", 1), F.lit("")), F.lit("0")).cast("int")
    return table(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def product_scan(spark: SparkSession, d: str) -> DataFrame:
    """Products rendered as lists and objects under differing field names, contact data among them, and read back."""
    cat = catalogue(spark, d, ["title", "org_name", "source_id"]).where(F.length(F.trim("title")) > 0).where(F.length(F.trim("org_name")) > 0)
    one = F.to_json(F.struct(F.col("title").alias("Product Name"), F.concat(F.lit("about "), "id").alias("Product Description"), F.col("org_name").alias("Company Name"), F.lit("a@b.example").alias("Business Email")))
    two = F.to_json(F.struct(F.col("title").alias("name"), F.concat(F.lit("about "), "id").alias("description"), F.col("org_name").alias("company")))
    payload = F.when(F.length("id") % 2 == 0, F.concat(F.lit("["), one, F.lit(', 7, {"name": "x"}]'))).otherwise(F.concat(F.lit('{"k 1": '), two, F.lit("}")))
    found = products.product_records(cat.select("id", payload.alias("payload")).withColumnRenamed("id", "page"), "page", "payload", "https://products.example")
    return found.select("page", "summary", "url", F.length("institute").alias("n_institute"))


def section_scan(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "catalogue_source").select("id", F.coalesce("name", F.lit("")).alias("name"))
    page = F.concat(F.lit("<h2>About us</h2><p>Some words on the site.</p><p>short</p><h2>Abc</h2><p>too short a title here</p><h2>"), text.html_escaped(F.col("name")), F.lit(" works</h2><p>First paragraph here.</p><p>Second paragraph here.</p><h2>About  us</h2><p>Again the same section.</p>"))
    return products.sectioned_pages(html.page_elements(src.select("id", page.alias("html")), "id", "html"), "id").select("id", "section", "title", "summary")


def maintained_texts(spark: SparkSession, d: str) -> DataFrame:
    """An index over the records of all snapshots, kept by a stream: the latest text of every id."""
    path = f"{d}/snapshot_recor[d].parquet" if os.path.isfile(f"{d}/snapshot_record.parquet") else f"{d}/snapshot_record.parquet"
    raw = spark.readStream.schema(table(spark, d, "snapshot_record").schema).parquet(path)
    keyed = raw.select(F.trim("id").alias("id"), F.concat_ws("|", F.lpad(F.col("snapshot_no").cast("string"), 4, "0"), F.coalesce(F.col("fetched_at").cast("string"), F.lit("")), F.coalesce("title", F.lit(""))).alias("version"), "title")
    built = index.maintained_index(index.content_versions(keyed, "id", "version", "title"), "id", "version", "digest", lambda rows: rows.withColumn("n_chars", F.length(F.coalesce("title", F.lit("")))), "texts")
    return built.select("id", "digest", "n_chars")


_IS_SEL = "(c IN ('27', '35') OR starts_with(c, '27.') OR starts_with(c, '35.'))"
_LABEL = "CASE code " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in taxonomy.LABELS.items()) + " ELSE '' END"
_RAW_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ('" + "', '".join(text.STOP_WORDS) + "'))"
_WORDS = f"list_transform(list_filter(list_zip({_RAW_WORDS}, range(1, len({_RAW_WORDS}) + 1)), lambda p: list_position({_RAW_WORDS}, p[1]) = p[2]), lambda p: p[1])[1:10]"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
SQL = {
    "redirect_links": "SELECT id, url || 'search?q=solar%20%26%20wind%205%25' AS link FROM catalogue_source WHERE length(url) > 0",
    "sources_ranked": f"WITH {CAT}, p AS (SELECT source_id, count(*) AS n FROM cat GROUP BY 1) SELECT s.id, n, CAST(row_number() OVER (ORDER BY n DESC NULLS LAST, s.id) AS INT) AS rank FROM catalogue_source s LEFT JOIN p ON p.source_id = s.id",
    "enriched_records": f"WITH {CAT}, o AS (SELECT id, min(sector_code) AS rc FROM sector_override GROUP BY 1), m AS (SELECT c.id, title, rc, coalesce(rc, sector_codes[1], 'other') AS code FROM cat c LEFT JOIN o ON o.id = c.id) SELECT id, code AS sector_code, {_LABEL} AS sector, CASE WHEN rc IS NOT NULL THEN 'reviewed_override' ELSE 'model_structured' END AS method, CASE WHEN rc IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, coalesce(array_to_string({_WORDS}, '|'), '') AS words FROM m",
    "request_batches": f"WITH {CAT}, p AS (SELECT id, source_id, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) // 5 AS batch FROM cat WHERE source_id IS NOT NULL) SELECT source_id, batch, string_agg(id, ',' ORDER BY id) AS ids FROM p GROUP BY 1, 2",
    "response_order": "WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) SELECT a.doc_id IS NOT NULL AS asked, b.doc_id IS NOT NULL AS answered, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1, 2",
    "flag_sources": f"WITH {CAT}, f AS (SELECT country, min(id) AS flag_source FROM catalogue_source WHERE length(country) > 0 GROUP BY 1) SELECT c.country, flag_source FROM (SELECT DISTINCT country FROM cat WHERE length(country) > 0) c LEFT JOIN f ON f.country = c.country",
    "display_cards": f"""WITH {CAT}, k AS (SELECT *, coalesce(list_position(list_transform(coalesce(sector_codes, []), lambda c: {_IS_SEL}), true), 0) AS hit FROM cat),
l AS (SELECT *, coalesce(coalesce(sector_labels, [])[CASE WHEN hit = 0 THEN 1 ELSE hit END], sector, '') AS label, greatest(len(coalesce(sector_labels, [])) - 1, 0) AS more FROM k)
SELECT id, {_ESC.format('label')} || CASE WHEN more > 0 AND label <> '' THEN ' +' || more ELSE '' END AS sector, CASE WHEN regexp_full_match(reg_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN coalesce(strftime(TRY_CAST(reg_date AS DATE), '%-d %b %Y'), '') ELSE '' END AS shown_date, coalesce({_ESC.format('title')}, '') AS title FROM l""",
    "title_from_address": f"WITH {CAT}, w AS (SELECT id, string_split(regexp_replace(regexp_extract(url, '([^/]+)/?$', 1), '[-_]+', ' ', 'g'), ' ') AS ws FROM cat WHERE length(url) > 0) SELECT id, array_to_string(list_transform(ws, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS title FROM w",
    "catalogue_order": f"WITH {CAT} SELECT id, row_number() OVER (ORDER BY lower(coalesce(title, '')) COLLATE C, lower(coalesce(org_name, '')) COLLATE C, id) - 1 AS place FROM cat",
    "readiness_levels": "SELECT CAST(coalesce(nullif(regexp_extract(text, 'TRL\\s*(\\d)', 1), ''), '0') AS INT) AS level, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "product_scan": f"WITH {CAT}, c AS (SELECT *, trim(regexp_replace(org_name, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) AS o FROM cat WHERE length(trim(title)) > 0 AND length(trim(org_name)) > 0) SELECT id AS page, 'about ' || id AS summary, CASE WHEN length(id) % 2 = 0 THEN 'https://products.example/0' ELSE 'https://products.example/k%201' END AS url, CAST(length(o) AS INT) AS n_institute FROM c",
    "section_scan": "SELECT id, CAST(1 AS BIGINT) AS section, 'About us' AS title, 'Some words on the site.' AS summary FROM catalogue_source UNION ALL SELECT id, 3, trim(regexp_replace(coalesce(name, '') || ' works', '\\s+', ' ', 'g')), 'First paragraph here. Second paragraph here.' FROM catalogue_source",
    "maintained_texts": "SELECT trim(id) AS id, sha256(coalesce(title, '')) AS digest, CAST(length(coalesce(title, '')) AS INT) AS n_chars FROM snapshot_record QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY snapshot_no DESC, fetched_at DESC, coalesce(title, '') DESC) = 1",
}
QUERIES = {name: globals()[name] for name in SQL}
