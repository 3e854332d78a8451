"""Round trips through the source readers: records are rendered in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import clean_space, html_escaped, repaired_encoding
from lodestar.plans.catalogue import CAT, catalogue, norm
from lodestar.sources import feeds, html
from lodestar.storage import table


def _shown(c: str) -> Column:
    return html_escaped(F.coalesce(F.col(c), F.lit("")))


def xml_scan(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["reference_id", "org_name", "dev_status"])
    item = F.concat(F.lit("<item><stechNum>"), _shown("id"), F.lit("</stechNum><orgName>"), _shown("org_name"), F.lit("</orgName><devStatusName>"), _shown("dev_status"), F.lit("</devStatusName><tcateNamem>M</tcateNamem><keyword>a; b;;</keyword><appFld>c, d</appFld></item>"))
    found = feeds.xml_items(cat.select("id", item.alias("xml")), "xml")
    return found.select("reference_id", "title", "sector", F.array_join("keywords", "|").alias("keywords"), "org_name", "dev_status")


def patent_scan(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["title", "org_name"])
    hit = F.to_json(F.struct(F.col("id").alias("identifier"), F.col("title").alias("inventionTitle"), F.concat(F.lit("First Ltd; "), F.coalesce("org_name", F.lit(""))).alias("applicants"), F.lit("20240131").alias("filingDate")))
    return feeds.patent_hits(cat.select(hit.alias("json")), "json").select("reference_id", "org_name", "reg_date")


def node_scan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("tid"), F.col("n_name").alias("name"))
    docs = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))

    def values(c: Column) -> Column:
        return F.array(F.struct(c.cast("string").alias("value")))

    def reference(c: Column) -> Column:
        return F.struct(c.cast("string").alias("target_id"))

    record = F.to_json(F.struct(values(F.col("doc_id")).alias("nid"), values(F.when(F.col("doc_id") % 10 == 0, "false").otherwise("True")).alias("status"), values(F.concat(F.lit(" T  "), F.col("doc_id"))).alias("title"), values(F.lit("")).alias("description"), values(F.col("n")).alias("body"), values(F.lit("trl_8_system_complete")).alias("readiness"), F.array(reference(F.col("doc_id") % 25), reference(F.lit("x")), reference(F.lit(99)), reference(F.col("doc_id") % 25)).alias("countries")))
    found = feeds.nodes(docs.select(record.alias("json")), "json", t, "https://nodes.example")
    return found.select("id", "title", "summary", "dev_status", "url", F.array_join("countries", ", ").alias("country"))


def html_table_scan(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["source_id", "org_name"])
    page = F.concat(F.lit("<html><script>var x = '<td>no</td>';</script><table><tr><th>h</th></tr><tr><td>"), _shown("id"), F.lit("</td><td><b>"), _shown("source_id"), F.lit("</b></td><td>"), _shown("org_name"), F.lit("</td></tr><tr><td>short</td></tr></table>"))
    rows = html.table_rows(html.page_elements(cat.select("id", page.alias("html")), "id", "html"), "id")
    return rows.select("id", F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"), F.get("cells", F.lit(2)).alias("c2"))


def html_link_scan(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "catalogue_source").select("id", "url")
    page = F.concat(F.lit("<h2>Food &amp; drink</h2><a href='/a b.pdf'>A</a><a href='/c.html'>C</a><h3>Health</h3><p><a href='"), F.col("url"), F.lit("x.pdf'>B</a></p><a href='https://skip.example/z.pdf'>Z</a>"))
    links = html.headed_links(html.page_elements(src.where(F.col("url") != "").select("id", page.alias("html")), "id", "html", "https://pages.example/"), "id", ".pdf", ("skip.example",))
    return links.select("category", "text", "href")


def encoding_repair(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are after repair: composed text that was never broken must not change."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(repaired_encoding(F.col("text"))).alias("digest"))


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["title"]).select("id", clean_space(F.lower(F.coalesce("title", F.lit("")))).alias("title"))


_SP = r"trim(regexp_replace({0}, '[\s\x{{A0}}\x{{3000}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}]+', ' ', 'g'))"
_ORG, _STATUS = _SP.format("coalesce(org_name, '')"), _SP.format("coalesce(dev_status, '')")
SQL = {
    "xml_scan": f"WITH {CAT} SELECT id AS reference_id, 'Untitled' AS title, 'M' AS sector, 'a|b|c|d' AS keywords, {_ORG} AS org_name, {_STATUS} AS dev_status FROM cat",
    "patent_scan": f"WITH {CAT} SELECT id AS reference_id, 'First Ltd' AS org_name, '2024-01-31' AS reg_date FROM cat",
    "node_scan": "SELECT 'node_' || doc_id AS id, 'T ' || doc_id AS title, CAST(length(coalesce(text, '')) AS VARCHAR) AS summary, 'TRL 8 — System complete' AS dev_status, 'https://nodes.example/node/' || doc_id AS url, n_name AS country FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE doc_id % 10 <> 0",
    "html_table_scan": f"WITH {CAT} SELECT id, id AS c0, coalesce(source_id, '') AS c1, {_ORG} AS c2 FROM cat",
    "html_link_scan": "SELECT 'Food & drink' AS category, 'A' AS text, 'https://pages.example/a%20b.pdf' AS href UNION ALL SELECT DISTINCT 'Health', 'B', url || 'x.pdf' FROM catalogue_source WHERE url <> ''",
    "encoding_repair": "SELECT doc_id, md5(text) AS digest FROM documents",
    "clean_titles": f"WITH {CAT} SELECT id, {norm('title')} AS title FROM cat",
}
QUERIES = {name: globals()[name] for name in SQL}
