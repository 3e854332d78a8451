"""Detail pages, listings and API answers rendered from the tables in varied forms, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.functions.text import html_escaped, repaired_encoding
from lodestar.operators import taxonomy
from lodestar.plans.catalogue import CAT, catalogue
from lodestar.sources import dimensions, feeds, html, pages, products, snapshots
from lodestar.storage import shared_path, table


def _plain(c: str) -> Column:
    """Latin words of a text that pages can hold: everything else as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z0-9]+", " "), " +", " "))


def detail_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four layouts in turn, each with and without its optional parts."""
    docs = table(spark, d, "documents").select("doc_id", _plain("text").alias("t"), F.col("doc_id").cast("string").alias("n"))
    odd = F.col("doc_id") % 8 >= 4
    level = (F.col("doc_id") % 9).cast("string")
    title = F.concat(F.lit("Unit &amp; no "), "n")
    words = F.concat(F.lit("About it and its uses: "), F.left("t", F.lit(60)), F.lit(" end"))
    innovation = F.concat(F.when(F.col("doc_id") % 24 == 8, "<div class='other'>").otherwise("<div class='detail pageContent'>"), F.lit("<b>Area of Technology:</b> Water <br>Title of the Innovation: "), title, F.lit(" <p>Brief About Innovation</p> "), words, F.when(odd, "<a>Express Interest</a> now").otherwise(""), F.lit("</div>"))
    profile = F.concat(
        F.lit("<title>Page</title><table>"), F.when(odd, "").otherwise(F.concat(F.lit("<tr><td class='tech_caption'>Title :</td><td class='tech_data'>"), title, F.lit("</td></tr>"))), F.lit("<tr><td class='tech_caption'>Value Proposition</td><td class='tech_data'>"), words, F.lit("</td></tr><tr><td>x</td></tr></table><div><p><img src='/img/lab/a.png' alt=' The  Lab '></p>"),
        F.when(odd, " [ABC–X1]").otherwise(""), F.lit("</div><div class='box box-info'><span class='label-primary'>Industrial Applications</span><i class='label-default'>Pumps [ Energy ]</i><i class='label-default'>Pumps [ Energy ]</i><i class='label-default'>Wells</i></div>"),
        F.when(odd, F.concat(F.lit("<script>renderTo: 'TRIGaugeDiv', data: ["), level, F.lit("]</script>"))).otherwise("<p>at trl 6 now</p>"),
    )
    article = F.concat(F.when(odd, F.concat(F.lit("<h1> "), title, F.lit("</h1>"))).otherwise("<title>Only a title</title>"), F.lit("<div class='field--name-body'><p>"), words, F.lit("</p><p></p></div><div class='field--name-field-profile-of-technologist'><p>A. Person<br>mail@college.example<br>Hill  College of Arts ,<br>For inquiries: Other Institute</p></div><p>TRL-"), level, F.lit("</p>"))
    status = F.concat(F.lit("<div id='page-content'>"), F.when(odd, F.concat(F.lit("<span class='h2 big font-weight-bold'>"), title, F.lit("</span>"))).otherwise(""), F.lit("<div class='d-block'>"), words, F.lit("</div><div class='d-block'>"), words, F.lit("</div><div class='d-block'>short</div></div><b class='text-success'>Prototype</b><div class='conversation-panel'><b class='font-weight-bold'>Hill Hub</b></div>"))
    kind = F.element_at(F.array(*[F.lit(k) for k in pages.READERS]), (F.col("doc_id") % 4 + 1).cast("int"))
    page = F.when(kind == "innovation", innovation).when(kind == "profile", profile).when(kind == "article", article).otherwise(status)
    url = F.concat(F.lit("https://x.example/content/"), "n", F.lit("-"), "n", F.lit("-a-quiet%20pump"))
    found = pages.page_records(docs.select("doc_id", page.alias("html"), url.alias("url"), kind.alias("layout")), "doc_id", "html", "url", "layout")
    return found.select("doc_id", "title", "sector", F.md5("summary").alias("summary"), "institute", "level")


def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Listings of twenty, some with links of their own kind, others only with the general ones."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 20).alias("page"))
    link = F.concat(F.lit("<a href='"), F.when(F.col("page") % 3 == 0, "/node/").otherwise("/technologies/all/item-"), F.col("doc_id"), F.lit("'>x</a><a href='/about'>y</a>"))
    listed = docs.groupBy("page").agg(F.concat(F.lit("<h2>List</h2><a href='/node/0'>home</a>"), F.array_join(F.array_sort(F.collect_list(link)), "")).alias("html"))
    return pages.listed_addresses(listed, "page", "html", "https://x.example/", "/technologies/[^/]+/.+", "/node/[1-9]")


def xml_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a feed, five items each, some refused; items are read, refusals told by code."""
    src = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("answer"))
    item = F.concat(F.lit("<item><stechNum>"), F.col("doc_id"), F.lit("</stechNum><techName>T &amp; "), F.col("doc_id"), F.lit("</techName></item>"))
    grouped = src.groupBy("answer").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"), F.count(F.lit(1)).alias("n"))
    bad = F.col("answer") % 6 == 1
    xml = F.concat(F.lit("<response><header><resultCode>"), F.when(bad, "22").otherwise("00"), F.lit("</resultCode><resultMsg>"), F.when(bad, "LIMIT").otherwise("OK"), F.lit("</resultMsg></header><body><items>"), "items", F.lit("</items><totalCount>"), F.col("n"), F.lit("</totalCount></body></response>"))
    found = feeds.xml_answers(grouped.select("answer", xml.alias("xml")), "xml")
    return found.select("answer", "code", "message", "total", "item.stechNum", "item.techName")


def node_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with references to sectors, in order, each once, unknown ones skipped."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("tid"), F.col("n_name").alias("name"))
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("tid"), F.concat(F.lit("Field "), F.col("n_nationkey")).alias("name"), F.concat(F.lit("C"), F.col("n_regionkey")).alias("code"))
    n = F.col("doc_id")

    def values(c: Column) -> Column:
        return F.array(F.struct(c.cast("string").alias("value")))

    refs = F.array(*[F.struct(x.cast("string").alias("target_id")) for x in (n % 25, (n * 7 + 1) % 31, F.lit("x"), n % 25)])
    record = F.to_json(F.struct(values(n).alias("nid"), values(F.lit("1")).alias("status"), values(F.concat(F.lit("T"), n)).alias("title"), refs.alias("sectors")))
    found = feeds.nodes(table(spark, d, "documents").select(record.alias("json")), "json", names, "https://nodes.example", own)
    return found.select("id", F.array_join("countries", ", ").alias("countries"), F.array_join("sectors", ", ").alias("sectors"), F.array_join("sector_codes", ",").alias("codes"))


def listing_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles inside the links of listing pages, by the number in the address; of a number on several pages the latest page's."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 20).alias("page"))
    shown = docs.unionByName(docs.where(F.col("doc_id") % 20 == 0).select("doc_id", (F.col("page") + 1).alias("page")))
    link = F.concat(F.lit("<a href='/content/"), F.col("doc_id"), F.lit("-x'><h5>No "), F.col("doc_id"), F.lit(" on "), F.col("page"), F.lit("</h5></a>"))
    listed = shown.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("html"))
    return products.listing_titles(html.page_elements(listed, "page", "html", "https://x.example/"), "page", r"/content/(\d+)-").select("id", "title")


def published_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Records published into place as a whole, twice, and read again: the second publication replaces the first."""
    target = shared_path(spark, "published")
    rows = catalogue(spark, d, ["source_id"]).select("id", "source_id")
    snapshots.publish(rows.limit(1), target, [])
    snapshots.publish(rows, target, [])
    return spark.read.parquet(target).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def reviewed_file(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written as CSV and read with their checks."""
    path = shared_path(spark, "reviews")
    table(spark, d, "sector_override").select("id", "sector_code", "reason").write.option("header", True).csv(path)
    return dimensions.read_overrides(spark, path, set(taxonomy.LABELS) | {taxonomy.OTHER}).select("id")


def request_values(spark: SparkSession, d: str) -> DataFrame:
    """Parameters as clients send them: lists in one value, and the address a request came from."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit(" a ,"), "event_type", F.lit(",, "), F.col("user_id")).alias("listed"), F.when(F.col("event_id") % 3 == 0, "x, 10.0.0.7 ").when(F.col("event_id") % 3 == 1, "nonsense").alias("forwarded"), F.when(F.col("event_id") % 2 == 0, "2001:DB8::1").otherwise("?").alias("peer"))
    return e.select("event_id", F.array_join(text.csv_values(F.col("listed")), "|").alias("listed"), text.client_address(F.col("forwarded"), F.col("peer")).alias("address"))


#: Letters and what their UTF-8 bytes look like when read as Mac Roman. Fixed values.
BROKEN = [("é", "√©"), ("ü", "√º"), ("–", "‚Äì"), ("’", "‚Äô"), ("ñ", "√±")]


def encoding_broken(spark: SparkSession, d: str) -> DataFrame:
    """Texts with wrongly read letters put in, repaired: every letter is back, plain text is as it was."""
    right, wrong = F.lit("".join(a for a, _ in BROKEN)), F.lit("".join(b for _, b in BROKEN))
    head = F.concat(F.lit("No "), F.col("doc_id"), F.lit(" caf"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(head, F.when(F.col("doc_id") % 2 == 0, wrong).otherwise(right)).alias("text"))
    return docs.select("doc_id", repaired_encoding(F.col("text")).alias("text"))


def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalogue_source").select("id", html_escaped(F.concat(F.lit("<'"), F.coalesce("name", F.lit("")), F.lit("'>"))).alias("shown"))


_T = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
_W = f"trim(regexp_replace('About it and its uses: ' || left({_T}, 60) || ' end', ' +', ' ', 'g'))"
_ODD = "doc_id % 8 >= 4"
SQL = {
    "detail_pages": f"""WITH p AS (SELECT doc_id, doc_id % 4 AS k, {_ODD} AS odd, 'Unit & no ' || doc_id AS title, {_W} AS w FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN title WHEN k = 1 THEN CASE WHEN odd THEN 'Page' ELSE title END WHEN k = 2 THEN CASE WHEN odd THEN title ELSE 'Only a title' END ELSE CASE WHEN odd THEN title ELSE doc_id || ' a quiet pump' END END AS title,
 CASE k WHEN 0 THEN 'Water' WHEN 1 THEN 'Pumps [ Energy ]; Wells' ELSE '' END AS sector, md5(w) AS summary,
 CASE k WHEN 1 THEN CASE WHEN odd THEN 'ABC-X1' ELSE 'The Lab' END WHEN 2 THEN 'Hill College of Arts' WHEN 3 THEN 'Hill Hub' ELSE '' END AS institute,
 CASE k WHEN 1 THEN CASE WHEN odd THEN 'TRL-' || doc_id % 9 ELSE 'TRL-6' END WHEN 2 THEN 'TRL-' || doc_id % 9 WHEN 3 THEN 'Prototype' ELSE '' END AS level FROM p WHERE NOT (k = 0 AND doc_id % 24 = 8)""",
    "listing_pages": "SELECT doc_id // 20 AS page, 'https://x.example/' || CASE WHEN (doc_id // 20) % 3 = 0 THEN 'node/' ELSE 'technologies/all/item-' END || doc_id AS url FROM documents WHERE NOT ((doc_id // 20) % 3 = 0 AND doc_id = 0)",
    "xml_answers": "WITH n AS (SELECT doc_id // 5 AS answer, count(*) AS n FROM documents GROUP BY 1) SELECT answer, '00' AS code, 'OK' AS message, n AS total, doc_id::VARCHAR AS stechNum, 'T & ' || doc_id AS techName FROM documents JOIN n ON answer = doc_id // 5 WHERE answer % 6 <> 1 UNION ALL SELECT answer, '22', 'LIMIT', n, NULL, NULL FROM n WHERE answer % 6 = 1",
    "node_sectors": "WITH r AS (SELECT doc_id, doc_id % 25 AS a, (doc_id * 7 + 1) % 31 AS b FROM documents) SELECT 'node_' || doc_id AS id, 'Unspecified' AS countries, 'Field ' || a || CASE WHEN y.n_nationkey IS NOT NULL AND b <> a THEN ', Field ' || b ELSE '' END AS sectors, 'C' || x.n_regionkey || CASE WHEN y.n_regionkey <> x.n_regionkey THEN ',C' || y.n_regionkey ELSE '' END AS codes FROM r JOIN nation x ON x.n_nationkey = a LEFT JOIN nation y ON y.n_nationkey = b",
    "encoding_broken": "SELECT doc_id, 'No ' || doc_id || ' caf" + "".join(a for a, _ in BROKEN) + "' AS text FROM documents",
    "listing_titles": "SELECT doc_id::VARCHAR AS id, 'No ' || doc_id || ' on ' || CASE WHEN doc_id % 20 = 0 THEN doc_id // 20 + 1 ELSE doc_id // 20 END AS title FROM documents",
    "published_snapshot": f"WITH {CAT} SELECT source_id, count(*) AS n FROM cat GROUP BY 1",
    "reviewed_file": "SELECT DISTINCT trim(id) AS id FROM sector_override",
    "request_values": "SELECT event_id, 'a|' || event_type || '|' || user_id AS listed, CASE WHEN event_id % 3 = 0 THEN '10.0.0.7' WHEN event_id % 2 = 0 THEN '2001:db8::1' ELSE 'unknown' END AS address FROM events",
    "escaped_titles": "SELECT id, '&lt;&#39;' || replace(replace(coalesce(name, ''), '&', '&amp;'), '''', '&#39;') || '&#39;&gt;' AS shown FROM catalogue_source",
}
QUERIES = {name: globals()[name] for name in SQL}
