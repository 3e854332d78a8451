"""What goes out and comes in: facet lists, links, requests and their answers, merged results, caches."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import text
from lodestar.functions.vectors import norm as length_of
from lodestar.functions.vectors import l2_normalised
from lodestar.operators import maintenance, taxonomy
from lodestar.operators.records import latest_per_key
from lodestar.plans.catalogue import CAT, catalogue, searchable
from lodestar.plans.quality_queries import _words
from lodestar.plans.search_queries import _FACET, SELECTED, _facets
from lodestar.sources.feeds import patent_links, patent_projection
from lodestar.storage import table

MERGED = ["harbour_tlo", "krungtech", "luzon_lab"]
PAGE, PAGE_SIZE = 2, 20
CAPACITY = 0.9
TODAY = "2024-01-30"


def _available() -> Column:
    """Whether the records of a source can be counted: it is active."""
    return F.coalesce(F.col("status") == "active", F.lit(False))


def facet_emitted(spark: SparkSession, d: str) -> DataFrame:
    """Facets as they are sent: sectors with a count or selected, in the order of the taxonomy, ``other`` last; countries by name and sources by registration, 0 where none and null where not countable."""
    counts = _facets(spark, d)
    src = table(spark, d, "catalogue_source")
    order = [*taxonomy.TOP_LEVEL, taxonomy.OTHER]
    domain = spark.createDataFrame([(c, {**taxonomy.TOP_LEVEL, taxonomy.OTHER: taxonomy.OTHER_LABEL}[c], i) for i, c in enumerate(order)], "value string, label string, ord int")
    sectors = domain.join(counts.where(F.col("facet") == "sector").select("value", "n"), "value", "left").where((F.col("n") > 0) | F.col("value").isin(SELECTED))
    sectors = sectors.select(F.lit("sector").alias("facet"), "value", "label", F.coalesce("n", F.lit(0)).alias("n"), "ord")
    homes = src.where(~F.coalesce("multi_country", F.lit(False)) & (F.length("country") > 0)).groupBy(F.col("country").alias("value")).agg(F.max(_available().cast("int")).alias("countable"))
    counted = counts.where(F.col("facet") == "country").select("value", "n")
    countries = homes.join(counted, "value", "full_outer").select(F.lit("country").alias("facet"), "value", F.col("value").alias("label"), F.coalesce("n", F.when(F.col("countable") == 1, F.lit(0).cast("long"))).alias("n"))
    countries = countries.withColumn("ord", F.row_number().over(Window.orderBy("value")) - 1)
    own = counts.where(F.col("facet") == "source").select(F.col("value").alias("id"), "n")
    sources = src.join(own, "id", "left").select(F.lit("source").alias("facet"), F.col("id").alias("value"), F.coalesce("name", F.lit("")).alias("label"), F.when(_available(), F.coalesce("n", F.lit(0))).alias("n"))
    sources = sources.withColumn("ord", F.row_number().over(Window.orderBy("value")) - 1)
    return sectors.unionByName(countries).unionByName(sources)


def patent_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a patent list: granted ones by their number, applications by the list's address."""
    number = F.when(F.length("id") % 3 == 0, F.regexp_replace("id", "[^0-9]", "")).otherwise(F.col("reference_id"))
    rows = catalogue(spark, d, ["title", "reference_id"]).select("id", "title", number.alias("patent_no"))
    return patent_projection(rows, "patent_no", "https://patents.example/pdf", "https://patents.example/list").select("id", "url", "reference_id", "record_type")


def patent_inquiries(spark: SparkSession, d: str) -> DataFrame:
    """Where a patent's card leads, how its number is shown, and the subject of an inquiry."""
    rows = catalogue(spark, d, ["title", "reference_id"]).select("id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.length("id") % 2 == 0, F.regexp_replace("id", "[^0-9]", "")).otherwise(F.coalesce("reference_id", F.lit(""))).alias("reference_id"))
    return patent_links(rows, "reference_id", "title", "https://patents.example/pdf", "https://search.example/?q=").select("id", F.md5("destination").alias("destination"), "reference_label", "reference_shown", F.md5("subject").alias("subject"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests of five documents each and the answers a model gave, some of them unusable."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("batch"))
    n = F.col("doc_id")
    asked = docs.select("batch", "doc_id")
    item = F.struct(
        F.when(F.col("batch") % 11 == 3, n + 1).otherwise(n).cast("string").alias("id"), F.when(F.col("batch") % 7 == 2, "zz").otherwise("27").alias("sector_code"),
        F.when(n % 29 == 0, "sure").otherwise("high").alias("confidence"), F.when(n % 31 == 0, " ").otherwise(F.concat(F.lit("T"), n)).alias("title_en"), F.lit("S").alias("summary_en"),
    )
    given = docs.groupBy("batch").agg(F.reverse(F.array_sort(F.collect_list(F.struct(n, item.alias("item"))))).alias("items"))
    body = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("items")))
    return asked, given.select("batch", F.when(F.col("batch") % 13 == 5, "{broken").otherwise(body).alias("answer"))


def responses_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers checked against their requests: the first fault of each batch, else its items in the order asked."""
    asked, answers = _answers(spark, d)
    return maintenance.parsed_responses(asked, answers, "batch", "doc_id", "answer", [*taxonomy.TOP_LEVEL, taxonomy.OTHER]).select("batch", "fault", F.array_join("ids", ",").alias("ids"))


def enriched_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether enriched records are as many as their sources and in the same order, and how many are at another place."""
    src = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("place"))
    out = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 4, F.col("doc_id") + 1).when(F.col("doc_id") % 10 == 5, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("place")).where(F.col("doc_id") % 17 != 0)
    return maintenance.order_verdict(src, out, "doc_id", "place")


def _hits(spark: SparkSession, d: str, source: str) -> DataFrame:
    rows = catalogue(spark, d, ["title", "source_id", "sector_codes"]).where(F.col("source_id") == source)
    return rows.select("id", "source_id", "title", "sector_codes")


def source_union(spark: SparkSession, d: str) -> DataFrame:
    """Results of several sources one after the other, in the order the sources were asked."""
    parts = [_hits(spark, d, s).select("id", "source_id", F.lit(i).alias("source_ord")) for i, s in enumerate(MERGED)]
    return reduce(DataFrame.unionByName, parts)


def category_interleave(spark: SparkSession, d: str) -> DataFrame:
    """A page out of several category requests in turn: of each category only as many rows as the page can need, a record found in several of them once."""
    rows = min(100, max(PAGE_SIZE, -(-PAGE * PAGE_SIZE // len(SELECTED))))
    cat = catalogue(spark, d, ["sector_codes"])
    own = F.filter(F.transform(F.coalesce("sector_codes", F.array().cast("array<string>")), lambda c: F.split_part(c, F.lit("."), F.lit(1))), lambda c: c.isin(SELECTED))
    groups = cat.select("id", F.explode(F.array_distinct(own)).alias("grp"))
    first = groups.withColumn("loc", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where(F.col("loc") <= rows)  # pruned before the shuffle
    place = F.array_position(F.array(*[F.lit(s) for s in SELECTED]), F.col("grp"))
    merged = first.groupBy("id").agg(F.min(F.struct("loc", place.alias("ord"))).alias("x")).select("id", "x.loc", "x.ord")
    page = merged.orderBy("loc", "ord").offset((PAGE - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    return page.withColumn("slot", F.row_number().over(Window.orderBy("loc", "ord")) - 1).select("slot", "id")


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of searches: equal parameters give equal keys, in whatever order their values are named."""
    e = table(spark, d, "events")
    query = F.concat(F.lit("  Query "), F.col("event_type"), F.lit("  "))
    sectors = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("27"), F.lit("35"))).otherwise(F.array(F.lit("35"), F.lit("27")))
    return e.select("event_id", maintenance.cache_key({"query": text.normalised(query), "sectors": F.array_join(F.array_sort(sectors), ","), "page": (F.col("event_id") % 3).cast("string")}, version="v2").alias("key"))


def single_flight(spark: SparkSession, d: str) -> DataFrame:
    """Queries asked at the same minute are run once: number of requests each run serves."""
    q = text.normalised(F.concat(F.col("event_type"), F.lit("  "), F.col("user_id") % 5))
    return table(spark, d, "events").groupBy(F.date_trunc("minute", "ts").alias("minute"), q.alias("query")).agg(F.count(F.lit(1)).alias("n"))


def evict_over_capacity(spark: SparkSession, d: str) -> DataFrame:
    """What a cache gives up that holds more than its capacity: as many entries as exceed it, those that expire first."""
    entries = table(spark, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires"))
    capacity = int(entries.count() * CAPACITY)
    return maintenance.evicted(entries, ["expires", "event_id"], capacity).select("event_id")


def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    """What a daily purge keeps: a row per day of the entries still alive at its end."""
    now = F.to_timestamp_ntz(F.lit(f"{TODAY} 00:00:00"))
    alive = table(spark, d, "events").where(F.col("ts") + F.expr("INTERVAL 7 DAYS") > now)
    return alive.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(T.BinaryType())
def packed_floats(values: pd.Series) -> pd.Series:
    """Vectors as little-endian 4-byte floats."""
    return values.map(lambda v: None if v is None else struct.pack(f"<{len(v)}f", *v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda b: None if b is None else list(struct.unpack(f"<{len(b) // 4}f", b)))


def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors packed into blobs and back."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("float")).alias("v")).withColumn("blob", packed_floats("v"))
    return v.select("vec_id", F.octet_length("blob").alias("n_bytes"), (unpacked_floats("blob") == F.col("v")).alias("same"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def letter_embedding(values: pd.Series) -> pd.Series:
    """Stands in for a service that embeds texts: counts of the letters a to h."""
    return values.map(lambda v: [float((v or "").lower().count(c)) for c in "abcdefgh"])


def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded by a pluggable function and brought to length one."""
    rows = table(spark, d, "documents").select("doc_id", letter_embedding("text").alias("v"))
    return rows.select("doc_id", F.round(F.try_element_at(l2_normalised(F.col("v")), F.lit(1)), 6).alias("a"), F.round(length_of(l2_normalised(F.col("v"))), 6).alias("length"))


def expanded_terms(spark: SparkSession, d: str) -> DataFrame:
    """Related terms of a record's title by a pluggable function (here its own keywords); only safe ones, eight at most, and none where fewer than three."""
    terms = F.slice(F.filter(text.keywords_of(F.col("title"), 3, 10), lambda t: text.is_safe_term(t, F.lit("pilot weeks"))), 1, 8)
    return catalogue(spark, d, ["title"]).select("id", F.array_join(F.when(F.size(terms) >= 3, terms).otherwise(F.array().cast("array<string>")), "|").alias("terms"))


def translation_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut for a translator into pieces of 500 characters and joined again."""
    size = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(size / 500).cast("int") - 1), lambda i: F.substring(F.col("text"), i * 500 + 1, F.lit(500)))
    rows = table(spark, d, "documents").where(size > 0).select("doc_id", "text", pieces.alias("pieces"))
    return rows.select("doc_id", F.size("pieces").alias("n"), (F.array_join("pieces", "") == F.col("text")).alias("same"))


def request_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Requests for a model: five documents each as JSON, summaries cut at 1,200 characters, with the codes it may answer."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("batch"), "doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(1200)).alias("summary"))
    grouped = docs.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", "summary"))).alias("records"))
    codes = ", ".join([*taxonomy.TOP_LEVEL, taxonomy.OTHER])
    prompt = F.concat(F.lit(f"Codes: {codes}\n"), F.array_join(F.transform("records", lambda r: F.concat(r["doc_id"].cast("string"), F.lit(": "), r["summary"])), "\n"))
    return grouped.select("batch", F.size("records").alias("n"), F.md5(prompt).alias("prompt"))


def page_bar(spark: SparkSession, d: str) -> DataFrame:
    """The page numbers a bar shows for every page of a result of ten: two around the current one, the ends, null for a gap."""
    total = 10
    pages = spark.range(1, total + 1).select(F.col("id").cast("int").alias("current"))
    near = F.sequence(F.greatest(F.lit(2), F.col("current") - 2), F.least(F.lit(total - 1), F.col("current") + 2))
    gap = F.array(F.lit(None).cast("int"))
    none = F.array().cast("array<int>")
    shown = F.concat(F.array(F.lit(1)), F.when(F.col("current") > 4, gap).otherwise(none), near, F.when(F.col("current") < total - 3, gap).otherwise(none), F.array(F.lit(total)))
    return pages.select("current", F.array_join(shown, " ", "..").alias("bar"))


def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The one record of a ten-digit number; anything else is refused before the table is read."""
    asked = [f"{n:010d}" for n in (0, 1, 17)] + ["12", "x000000001"]
    valid = [a for a in asked if len(a) == 10 and a.isdigit()]
    rows = table(spark, d, "documents").where(F.col("doc_id").isin([int(v) for v in valid])).select("doc_id", "lang")
    return rows.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("number"), "lang")


def indexable_records(spark: SparkSession, d: str) -> DataFrame:
    """Records an index is built of: those of sources that expose records, that is active ones."""
    src = table(spark, d, "catalogue_source").where(_available()).select(F.col("id").alias("source_id"))
    return catalogue(spark, d, ["source_id"]).join(src, "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def link_record_rules(spark: SparkSession, d: str) -> DataFrame:
    """Faults of records by the rules of one listing: title, known category, address, excluded address, repeated ids."""
    rows = catalogue(spark, d, ["title", "sector", "url"])
    excluded = "https://harbour-tlo.example/offer/4"
    tests = [(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0, "no title"), (~F.coalesce(F.col("sector").isin(*taxonomy.TOP_LEVEL.values()), F.lit(False)), "unknown category"), (~text.is_valid_url(F.col("url")), "invalid url"), (F.coalesce(F.regexp_replace("url", "/+$", "") == excluded, F.lit(False)), "excluded url")]
    faults = F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))
    return rows.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def search_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits under full compatibility composition: full-width and ligature forms of the query's letters match too."""
    wide = F.translate(F.coalesce("title", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    shown = F.when(F.length("id") % 2 == 0, wide).otherwise(F.col("title"))
    return catalogue(spark, d, ["title"]).select("id", text.normalised_exact(shown).alias("form")).where(F.col("form").contains("solar")).select("id", "form")


def read_usage(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of an index: its content hashes that are current, by source."""
    now = catalogue(spark, d, ["source_id"], digest=F.md5(searchable()))
    held = table(spark, d, "technology").groupBy("id").agg(F.min_by(F.md5(searchable()), "fetched_at").alias("held"))
    return now.join(held, "id").groupBy("source_id").agg(F.count_if(F.col("digest") == F.col("held")).alias("current"), F.count(F.lit(1)).alias("n"))


def locked_first(spark: SparkSession, d: str) -> DataFrame:
    """For every country the source registered first (by its day of indexing, then its name)."""
    src = table(spark, d, "catalogue_source").where(F.length("country") > 0)
    return latest_per_key(src.withColumn("back", -F.unix_date(F.try_to_date(F.col("last_indexed"), "yyyy-MM-dd"))), ["country"], ["back"], ["id"]).select("country", F.col("id").alias("source_id"))


_OK = "coalesce(status = 'active', false)"
_HOME = f"(SELECT country AS value, max({_OK}::INT) AS countable FROM catalogue_source WHERE NOT coalesce(multi_country, false) AND length(country) > 0 GROUP BY 1)"
_ORDER = [*taxonomy.TOP_LEVEL, taxonomy.OTHER]
_LABELS = {**taxonomy.TOP_LEVEL, taxonomy.OTHER: taxonomy.OTHER_LABEL}
_DOMAIN = "(VALUES " + ", ".join(f"('{c}', '{_LABELS[c]}', {i})" for i, c in enumerate(_ORDER)) + ") AS v(value, label, ord)"
_NUM3 = "CASE WHEN length(id) % 3 = 0 THEN regexp_replace(id, '[^0-9]', '', 'g') ELSE coalesce(trim(reference_id), '') END"
_NUM2 = "CASE WHEN length(id) % 2 = 0 THEN regexp_replace(id, '[^0-9]', '', 'g') ELSE trim(coalesce(reference_id, '')) END"
_B = "(doc_id // 5)"
_MERGE_ROWS = min(100, max(PAGE_SIZE, -(-PAGE * PAGE_SIZE // len(SELECTED))))
_SEL = "[" + ", ".join(f"'{s}'" for s in SELECTED) + "]"
_SAFE = "list_filter({0}, lambda t: t <> 'pilot weeks' AND length(t) BETWEEN 2 AND 80)"
_TERMS = _SAFE.format(_words("title", 3, 10)) + "[1:8]"
SQL = {
    "facet_emitted": _FACET + f""" SELECT 'sector' AS facet, v.value, v.label, coalesce(g.n, 0) AS n, CAST(v.ord AS INT) AS ord FROM {_DOMAIN} LEFT JOIN g ON g.facet = 'sector' AND g.value = v.value WHERE g.n > 0 OR v.value IN ('27', '07', 'other')
UNION ALL SELECT 'country', value, value, coalesce(n, CASE WHEN countable = 1 THEN 0 END), CAST(row_number() OVER (ORDER BY value) - 1 AS INT) FROM (SELECT coalesce(h.value, c.value) AS value, countable, n FROM {_HOME} h FULL JOIN (SELECT value, n FROM g WHERE facet = 'country') c ON c.value = h.value)
UNION ALL SELECT 'source', s.id, coalesce(s.name, ''), CASE WHEN {_OK} THEN coalesce(g.n, 0) END, CAST(row_number() OVER (ORDER BY s.id) - 1 AS INT) FROM catalogue_source s LEFT JOIN g ON g.facet = 'source' AND g.value = s.id""",
    "patent_records": f"WITH {CAT}, p AS (SELECT id, {_NUM3} AS r FROM cat) SELECT id, CASE WHEN regexp_full_match(r, '[0-9]+') THEN 'https://patents.example/pdf/US' || r || 'B2.pdf' ELSE 'https://patents.example/list' END AS url, r AS reference_id, CASE WHEN regexp_full_match(r, '[0-9]+') THEN 'US Patent' ELSE 'US Patent Application' END AS record_type FROM p",
    "patent_inquiries": f"""WITH {CAT}, p AS (SELECT id, coalesce(title, '') AS title, {_NUM2} AS r FROM cat), q AS (SELECT *, regexp_full_match(r, '[0-9]+') AS granted FROM p)
SELECT id, md5(CASE WHEN granted THEN 'https://patents.example/pdf/US' || r || 'B2.pdf' ELSE 'https://search.example/?q=' || url_encode('"' || r || '" "' || title || '"') END) AS destination, CASE WHEN granted THEN 'US patent number' ELSE 'US application number' END AS reference_label,
 CASE WHEN r = '' THEN 'See the listing' WHEN granted THEN 'US ' || r ELSE r END AS reference_shown, md5('Licensing inquiry – ' || CASE WHEN r = '' THEN title WHEN granted THEN 'US Patent ' || r ELSE 'US Patent Application ' || r END) AS subject FROM q""",
    "responses_parsed": f"""WITH b AS (SELECT {_B} AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, max((doc_id % 29 = 0)::INT) AS bad_sure, max((doc_id % 31 = 0)::INT) AS bad_title FROM documents GROUP BY 1),
f AS (SELECT *, CASE WHEN batch % 13 = 5 THEN 'invalid answer' WHEN batch % 11 = 3 THEN 'other ids' WHEN batch % 7 = 2 THEN 'invalid code' WHEN bad_sure = 1 THEN 'invalid confidence' WHEN bad_title = 1 THEN 'empty title' ELSE '' END AS fault FROM b) SELECT batch, fault, CASE WHEN fault = '' THEN ids ELSE '' END AS ids FROM f""",
    "enriched_order": "WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS at FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY CASE doc_id % 10 WHEN 4 THEN doc_id + 1 WHEN 5 THEN doc_id - 1 ELSE doc_id END, doc_id) AS at FROM documents WHERE doc_id % 17 <> 0), c AS (SELECT (SELECT count(*) FROM s) AS n_source, (SELECT count(*) FROM o) AS n_enriched, count(*) FILTER (s.at IS DISTINCT FROM o.at) AS n_elsewhere FROM s FULL JOIN o ON s.doc_id = o.doc_id) SELECT n_source, n_enriched, n_elsewhere, n_source = n_enriched AND n_elsewhere = 0 AS same FROM c",
    "source_union": f"WITH {CAT} SELECT id, source_id, CAST(list_position(['harbour_tlo', 'krungtech', 'luzon_lab'], source_id) - 1 AS INT) AS source_ord FROM cat WHERE source_id IN ('harbour_tlo', 'krungtech', 'luzon_lab')",
    "category_interleave": f"""WITH {CAT}, g AS (SELECT id, unnest(list_distinct(list_filter(list_transform(coalesce(sector_codes, []), lambda c: split_part(c, '.', 1)), lambda c: list_contains({_SEL}, c)))) AS grp FROM cat),
l AS (SELECT id, list_position({_SEL}, grp) AS ord, row_number() OVER (PARTITION BY grp ORDER BY id) AS loc FROM g), m AS (SELECT id, min((loc, ord)) AS x FROM l WHERE loc <= {_MERGE_ROWS} GROUP BY 1), p AS (SELECT id, row_number() OVER (ORDER BY x) - 1 AS pos FROM m) SELECT CAST(pos - {(PAGE - 1) * PAGE_SIZE} AS INT) AS slot, id FROM p WHERE pos >= {(PAGE - 1) * PAGE_SIZE} AND pos < {PAGE * PAGE_SIZE}""",
    "cache_keys": """SELECT event_id, md5('{"page":"' || (event_id % 3) || '","query":"query ' || event_type || '","sectors":"27,35","version":"v2"}') AS key FROM events""",
    "single_flight": "SELECT date_trunc('minute', ts) AS minute, event_type || ' ' || (user_id % 5) AS query, count(*) AS n FROM events GROUP BY 1, 2",
    "evict_over_capacity": f"SELECT event_id FROM events ORDER BY ts, event_id LIMIT (SELECT count(*) - CAST(floor(count(*) * {CAPACITY}::DOUBLE) AS BIGINT) FROM events)",
    "purge_expired": f"SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '{TODAY}' GROUP BY 1",
    "vector_blobs": "SELECT vec_id, CAST(len(embedding) * 4 AS INT) AS n_bytes, true AS same FROM embeddings",
    "embedded_texts": "WITH v AS (SELECT doc_id, " + ", ".join(f"length(lower(text)) - length(replace(lower(text), '{c}', '')) AS n{c}" for c in "abcdefgh") + " FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), z AS (SELECT doc_id, na, sqrt(" + " + ".join(f"n{c} * n{c}" for c in "abcdefgh") + ") AS l FROM v) SELECT doc_id, CASE WHEN l > 0 THEN round(na / l, 6) ELSE 0::DOUBLE END AS a, CASE WHEN l > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS length FROM z",
    "expanded_terms": f"WITH {CAT}, t AS (SELECT id, {_TERMS} AS t FROM cat) SELECT id, CASE WHEN len(t) >= 3 THEN array_to_string(t, '|') ELSE '' END AS terms FROM t",
    "translation_chunks": "SELECT doc_id, CAST(ceil(length(text) / 500.0) AS INT) AS n, true AS same FROM documents WHERE length(text) > 0",
    "request_prompts": f"SELECT {_B} AS batch, CAST(count(*) AS INT) AS n, md5('Codes: {', '.join(_ORDER)}' || chr(10) || string_agg(doc_id || ': ' || substr(coalesce(text, ''), 1, 1200), chr(10) ORDER BY doc_id)) AS prompt FROM documents GROUP BY 1",
    "page_bar": "WITH p AS (SELECT CAST(unnest(range(1, 11)) AS INT) AS c) SELECT c AS current, '1 ' || CASE WHEN c > 4 THEN '.. ' ELSE '' END || array_to_string(range(greatest(2, c - 2), least(9, c + 2) + 1), ' ') || CASE WHEN c < 7 THEN ' ..' ELSE '' END || ' 10' AS bar FROM p",
    "status_lookup": "SELECT lpad(doc_id::VARCHAR, 10, '0') AS number, lang FROM documents WHERE doc_id IN (0, 1, 17)",
    "indexable_records": f"WITH {CAT} SELECT source_id, count(*) AS n FROM cat WHERE source_id IN (SELECT id FROM catalogue_source WHERE {_OK}) GROUP BY 1",
    "link_record_rules": f"WITH {CAT}, f AS (SELECT unnest(list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'no title' END, CASE WHEN NOT coalesce(sector IN ('" + "', '".join(taxonomy.TOP_LEVEL.values()) + "'), false) THEN 'unknown category' END, CASE WHEN NOT regexp_matches(coalesce(url, ''), '^https?://[^/?#\\s]+') THEN 'invalid url' END, CASE WHEN rtrim(url, '/') = 'https://harbour-tlo.example/offer/4' THEN 'excluded url' END], lambda x: x IS NOT NULL)) AS fault FROM cat) SELECT fault, count(*) AS n FROM f GROUP BY 1",
    "search_compatible": f"WITH {CAT}, f AS (SELECT id, title, trim(regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '\\s+', ' ', 'g')) AS form FROM cat) SELECT id, form FROM f WHERE contains(form, 'solar') AND regexp_full_match(title, '[\\x00-\\x7F]*')",
    "read_usage": f"WITH {CAT}, h AS (SELECT DISTINCT id FROM technology) SELECT source_id, count(*) AS current, count(*) AS n FROM cat GROUP BY 1",
    "locked_first": "SELECT country, id AS source_id FROM catalogue_source WHERE length(country) > 0 QUALIFY row_number() OVER (PARTITION BY country ORDER BY TRY_CAST(last_indexed AS DATE) ASC NULLS LAST, id DESC) = 1",
}
QUERIES = {name: globals()[name] for name in SQL}
