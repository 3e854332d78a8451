"""Projection, quality, maintenance and text functions over the catalogue and its snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.functions.vectors import dot
from lodestar.operators import maintenance, taxonomy
from lodestar.operators.records import latest_per_key
from lodestar.plans.catalogue import CAT, SEARCHABLE, SEARCHED, catalogue, norm, searchable
from lodestar.storage import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def project_technology(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every snapshot id as a catalogue record: constants of the source, defaults, labels."""
    s = table(spark, d, "snapshot_record")
    src = table(spark, d, "catalogue_source").select(F.col("id").alias("source_id"), "name", F.col("country").alias("source_country"), "institution", F.col("transfer_type").alias("kind"))
    kept = latest_per_key(s.select("source_id", text.clean_space(F.col("id")).alias("id"), "snapshot_no", "fetched_at", "title", "summary", "institute", "trl", "url", "sector_codes"), ["source_id", "id"], ["snapshot_no", "fetched_at", "title", "summary", "institute", "trl", "url"], ["title", "summary", "institute", "trl", "url", "sector_codes"])
    org = F.coalesce(F.nullif("institute", F.lit("")), "institution", F.lit(""))
    return kept.join(src, "source_id", "left").select("id", "source_id", F.coalesce("name", F.lit("")).alias("source_name"), F.coalesce("source_country", F.lit("")).alias("country"), F.coalesce("title", F.lit("")).alias("title"), F.length(F.coalesce("summary", F.lit(""))).alias("summary_chars"), org.alias("org_name"), F.coalesce("kind", F.lit("")).alias("transfer_type"), F.coalesce("trl", F.lit("")).alias("dev_status"), F.lit(taxonomy.SCHEME).alias("taxonomy_scheme"))


def project_public_fields(spark: SparkSession, d: str) -> DataFrame:
    """An allow-list of fields; contact data and links are masked out of the summary."""
    masked = F.regexp_replace(F.coalesce("summary", F.lit("")), r"(https?://\S+|www\.\S+|\S+@\S+)", "[link]")
    cat = catalogue(spark, d, ["title"], masked=F.when(masked.contains("[link]"), masked))
    return cat.where(F.col("masked").isNotNull()).select("id", "title", F.col("masked").alias("summary"))


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id", "source")
    return maintenance.first_per_key(rows, ["digest"], [F.col("doc_id")], ["digest", "doc_id", "source"]).select("doc_id", "source")


def dedupe_richest(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue(spark, d, [], t=F.lower(F.coalesce("title", F.lit(""))), o=F.lower(F.coalesce("org_name", F.lit(""))), n=F.length(F.coalesce("summary", F.lit(""))))
    return maintenance.first_per_key(rows, ["t", "o"], [-F.col("n"), F.col("id")], ["id", "n"]).select("id", F.col("n").alias("summary_chars"))


def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.duplicates(table(spark, d, "technology"), {"id": F.col("id"), "url": F.col("url"), "title": text.normalised(F.col("title"))})


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """All snapshots with the number of the delivery of the same source before each (null for the first)."""
    s = table(spark, d, "snapshot_record")
    w = Window.partitionBy("source_id").orderBy("snapshot_no")
    deliveries = s.select("source_id", "snapshot_no").distinct().select("source_id", "snapshot_no", F.lag("snapshot_no").over(w).alias("before_no"))
    return s.join(deliveries, ["source_id", "snapshot_no"])


def snapshot_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of added, removed, changed and shared ids of every two successive deliveries of a source."""
    content = F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))))
    s = table(spark, d, "snapshot_record").where(F.col("source_id").isNotNull())
    rows = latest_per_key(s.select("source_id", "snapshot_no", F.trim("id").alias("id"), "fetched_at", content.alias("h")), ["source_id", "snapshot_no", "id"], ["fetched_at"], ["h"])
    w = Window.partitionBy("source_id").orderBy("snapshot_no")
    steps = s.select("source_id", "snapshot_no").distinct().select("source_id", "snapshot_no", F.lead("snapshot_no").over(w).alias("after"))
    rows = rows.join(steps, ["source_id", "snapshot_no"])
    # every row stands once as the newer and once as the older side, so one aggregation by key compares all pairs
    sides = rows.select("source_id", "id", F.col("snapshot_no").alias("no"), F.lit(None).cast("string").alias("a"), F.col("h").alias("b")).unionByName(rows.where(F.col("after").isNotNull()).select("source_id", "id", F.col("after").alias("no"), F.col("h").alias("a"), F.lit(None).cast("string").alias("b")))
    both = sides.groupBy("source_id", "no", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    first = s.groupBy("source_id").agg(F.min("snapshot_no").alias("first"))
    counted = both.join(first, "source_id").where(F.col("no") > F.col("first"))
    return counted.groupBy("source_id", F.col("no").alias("snapshot_no")).agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))


def snapshot_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of every source judged against the one before it."""
    s = _numbered(spark, d)
    key = F.concat_ws("|", "source_id", "snapshot_no")
    before = s.groupBy("source_id", "snapshot_no").agg(F.count(F.lit(1)).alias("n_rows"), F.max("before_no").alias("before_no"))
    previous = before.alias("x").join(before.alias("y"), (F.col("x.source_id") == F.col("y.source_id")) & (F.col("x.before_no") == F.col("y.snapshot_no"))).select(F.concat_ws("|", "x.source_id", "x.snapshot_no").alias("delivery"), F.col("y.n_rows").alias("n_rows"))
    return maintenance.validated(s.select(key.alias("delivery"), F.trim("id").alias("id"), "title", "url"), "delivery", "id", "title", "url", 3, previous)


def enriched_validation(spark: SparkSession, d: str) -> DataFrame:
    """One row of checks over records and their translated titles."""
    s = table(spark, d, "snapshot_record").where(F.col("title_translation_status").isNotNull())
    known = F.col("sector_code").isin(*taxonomy.TOP_LEVEL, taxonomy.OTHER)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0).alias("empty_titles"), F.count_if(F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0).alias("empty_summaries"), F.count_if(~F.coalesce(known, F.lit(False))).alias("invalid_codes"), F.count_if(F.coalesce(text.is_thai(F.col("title")), F.lit(False))).alias("thai_titles")).withColumn("too_many_thai", F.col("thai_titles") > F.greatest(F.lit(3), F.ceil(F.col("n") * 0.02)))


def translation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_record").where(F.col("title_original").isNotNull())
    code = F.when(F.length("title_original") % 7 == 0, 429).when(F.length("title_original") % 11 == 0, 500).otherwise(200)
    return s.select(text.translation_status(F.col("title_original"), F.col("title"), code, F.lit("")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    """Records of every delivery that an index of the delivery before it has not, or has with other content."""
    digest = text.content_hash(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))))
    rows = _numbered(spark, d).select("source_id", F.col("snapshot_no"), "before_no", F.trim("id").alias("id"), "fetched_at", digest.alias("digest"))
    kept = latest_per_key(rows, ["source_id", "snapshot_no", "id"], ["fetched_at"], ["digest", "before_no"])
    key = F.concat_ws("|", "source_id", F.coalesce("snapshot_no", F.lit(-1)).cast("string"), "id")
    older = F.concat_ws("|", "source_id", F.coalesce("before_no", F.lit(-1)).cast("string"), "id")
    return maintenance.pending(kept.withColumn("key", older), kept.select(key.alias("key"), "digest"), "key", "digest").select("source_id", "snapshot_no", "id", "digest")


def missing_from_index(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    old, new = rows.where(F.col("event_id") % 2 == 0), rows.where(F.col("event_id") % 2 == 1)
    version = F.struct("ts", "event_id")
    return maintenance.upserted(old.withColumn("version", version), new.withColumn("version", version), ["user_id", "event_type"], "version").select("user_id", "event_type", "event_id", "value")


def upsert_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("relevance"), F.col("ts").alias("seen"))
    found = maintenance.merged_terms(rows, ["user_id", "event_type"])
    return found.select("user_id", "event_type", F.round("relevance", 6).alias("relevance"), "evidence_count", "last_seen")


def related_terms_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = maintenance.merged_terms(table(spark, d, "events").select("user_id", "event_type", F.col("value").alias("relevance"), F.col("ts").alias("seen")), ["user_id", "event_type"])
    w = Window.partitionBy("user_id").orderBy(F.round("relevance", 6).desc(), F.col("evidence_count").desc(), "event_type")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2).select("user_id", "event_type", "rank")


def related_term_mining(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the ten records nearest to a query vector, with the best similarity each: the learning gate."""
    v = table(spark, d, "embeddings")
    first = v.where(F.col("vec_id") == 1).select("embedding").first()
    if first is None:
        return spark.createDataFrame([], "term string, relevance double")
    near = v.select(F.col("vec_id").alias("doc_id"), F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first[0]])), 6).alias("s")).orderBy(F.col("s").desc(), "doc_id").limit(10)
    words = F.explode(text.keywords_of(F.col("text"), 6, 5))
    found = _documents(spark, d).select("doc_id", "text").join(F.broadcast(near), "doc_id").select(words.alias("term"), "s").groupBy("term").agg(F.max("s").alias("relevance"))
    return found.where(text.is_safe_term(F.col("term"), F.lit("pilot weeks"))).orderBy(F.col("relevance").desc(), "term").limit(8)


def sensitive_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(text.is_sensitive(F.col("text"))).select("doc_id")


def normalise_and_hash(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, [], digest=text.content_hash(text.normalised(F.col("title"))))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["url"]).where(F.col("url").isNotNull()).select("id", text.stable_id("rec_", F.col("url")).alias("stable_id"), F.md5("url").alias("cache_key"))


def keywords_from_title(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, [], words=F.array_join(text.keywords_of(F.col("title")), "|"))


def document_text_template(spark: SparkSession, d: str) -> DataFrame:
    whole = text.document_text(*[F.col(c) for c in SEARCHED])
    return catalogue(spark, d, [], digest=F.md5(whole), n_chars=F.length(whole))


def searchable_length(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, [], n_chars=F.length(searchable()))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return catalogue(spark, d, ["url"]).select("id", text.is_valid_url(F.col("url")).alias("valid"), F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"), F.endswith(F.lower(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)), F.lit(".pdf")).alias("is_pdf"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.md5(text.html_escaped(text.display_text(F.col("text")))).alias("digest"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["title"]).select("id", F.coalesce(text.slug(F.col("title")), F.lit("")).alias("slug"))


def source_initials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalogue_source").select("id", text.initials(F.col("name")).alias("initials"))


def date_notation(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["reg_date"]).where(F.col("reg_date").isNotNull()).select("id", text.iso_date(F.col("reg_date")).alias("reg_date"), text.length_bucket(F.length("reg_date")).alias("bucket"))


def title_patch(spark: SparkSession, d: str) -> DataFrame:
    """Titles of records replaced by the listed original ones, where there is one."""
    s = table(spark, d, "snapshot_record").where(F.length(F.trim("title_original")) > 0).groupBy(F.trim("id").alias("id")).agg(F.max("title_original").alias("listed"))
    rows = table(spark, d, "snapshot_record").groupBy(F.trim("id").alias("id")).agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("snapshot_no", "fetched_at", "title"))).alias("title"))
    return rows.join(s, "id", "left").select("id", F.coalesce("listed", "title").alias("title"))


def mapping_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the mapping that the taxonomy lacks, and preferred codes named twice."""
    m = table(spark, d, "source_sector_map").select("source_sector", F.explode("ics_codes").alias("code"))
    missing = m.join(table(spark, d, "ics_sector"), "code", "left_anti").select(F.lit("unknown code").alias("problem"), F.col("code").alias("value"))
    twice = table(spark, d, "ntb_to_ics").where(F.length(F.trim("preferred_query_for")) > 0).groupBy("preferred_query_for").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("preferred twice").alias("problem"), F.col("preferred_query_for").alias("value"))
    return missing.unionByName(twice)


def label_code_union(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one category merged over its rows, in order, each once."""
    m = table(spark, d, "source_sector_map").select("source_sector", F.posexplode("ics_codes").alias("pos", "code"))
    merged = m.groupBy(F.lower("source_sector").alias("category")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])).alias("codes"))
    return merged.select("category", F.array_join("codes", "|").alias("codes"))


def filter_delta(spark: SparkSession, d: str) -> DataFrame:
    """Codes that a review adds to and takes from a record's stored ones."""
    reviewed = table(spark, d, "sector_override").groupBy("id").agg(F.array_sort(F.collect_set("sector_code")).alias("now"))
    cat = catalogue(spark, d, ["sector_codes"]).select("id", F.coalesce("sector_codes", F.array().cast("array<string>")).alias("before"))
    return cat.join(reviewed, "id").select("id", F.array_join(F.array_sort(F.array_except("now", "before")), "|").alias("added"), F.array_join(F.array_sort(F.array_except("before", "now")), "|").alias("removed"))


def url_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "technology").select("url")
    b = table(spark, d, "snapshot_record").select("url")
    return a.unionByName(b).where(F.length("url") > 0).distinct().groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["sector", "record_type"]).groupBy(F.coalesce("sector", F.lit("")).alias("sector"), F.coalesce("record_type", F.lit("")).alias("record_type")).agg(F.count(F.lit(1)).alias("n"))


_H = "md5(coalesce(title, '') || chr(10) || coalesce(summary, ''))"
_KEPT = f"k AS (SELECT source_id, snapshot_no, trim(id) AS id, {_H} AS h FROM snapshot_record WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, snapshot_no, trim(id) ORDER BY fetched_at DESC, {_H} DESC) = 1), dl AS (SELECT source_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source_id ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT source_id, snapshot_no FROM snapshot_record))"
_STOP = "('" + "', '".join(text.STOP_WORDS) + "')"


def _words(column: str, longer: int, most: int) -> str:
    raw = f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^a-z0-9]+'), lambda w: length(w) > {longer} AND w NOT IN {_STOP})"
    return f"list_transform(list_filter(list_zip({raw}, range(1, len({raw}) + 1)), lambda p: list_position({raw}, p[1]) = p[2]), lambda p: p[1])[1:{most}]"


def _repaired(x: str) -> str:
    for a, b in text.DISPLAY_REPAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_DOC = "substr('Title: ' || trim(coalesce(title, '')) || chr(10) || 'Summary: ' || trim(coalesce(summary, '')) || chr(10) || 'Keywords: ' || coalesce(array_to_string(keywords, ', '), '') || chr(10) || 'Institution: ' || trim(coalesce(org_name, '')), 1, 6000)"
SQL = {
    "project_technology": f"""WITH k AS (SELECT source_id, trim(regexp_replace(id, '\\s+', ' ', 'g')) AS id, title, summary, institute, trl, url FROM snapshot_record
  QUALIFY row_number() OVER (PARTITION BY source_id, trim(regexp_replace(id, '\\s+', ' ', 'g')) ORDER BY snapshot_no DESC, fetched_at DESC, title DESC NULLS LAST, summary DESC NULLS LAST, institute DESC NULLS LAST, trl DESC NULLS LAST, url DESC NULLS LAST) = 1)
SELECT k.id, k.source_id, coalesce(s.name, '') AS source_name, coalesce(s.country, '') AS country, coalesce(title, '') AS title, CAST(length(coalesce(summary, '')) AS INT) AS summary_chars, coalesce(nullif(institute, ''), s.institution, '') AS org_name, coalesce(s.transfer_type, '') AS transfer_type, coalesce(trl, '') AS dev_status, 'ISO ICS' AS taxonomy_scheme FROM k LEFT JOIN catalogue_source s ON s.id = k.source_id""",
    "project_public_fields": f"WITH {CAT}, m AS (SELECT id, title, regexp_replace(coalesce(summary, ''), '(https?://\\S+|www\\.\\S+|\\S+@\\S+)', '[link]', 'g') AS summary FROM cat) SELECT * FROM m WHERE contains(summary, '[link]')",
    "dedupe_first_wins": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1",
    "dedupe_richest": f"WITH {CAT} SELECT id, CAST(length(coalesce(summary, '')) AS INT) AS summary_chars FROM cat QUALIFY row_number() OVER (PARTITION BY lower(coalesce(title, '')), lower(coalesce(org_name, '')) ORDER BY length(coalesce(summary, '')) DESC, id) = 1",
    "duplicate_values": f"SELECT kind, value, count(*) AS n FROM (SELECT 'id' AS kind, id AS value FROM technology UNION ALL SELECT 'url', url FROM technology UNION ALL SELECT 'title', {norm('title')} FROM technology) WHERE length(value) > 0 GROUP BY 1, 2 HAVING count(*) > 1",
    "snapshot_diff_counts": f"WITH {_KEPT}, n AS (SELECT d.source_id, d.snapshot_no, k.id, k.h FROM dl d JOIN k ON k.source_id = d.source_id AND k.snapshot_no = d.snapshot_no WHERE before_no IS NOT NULL), o AS (SELECT d.source_id, d.snapshot_no, k.id, k.h FROM dl d JOIN k ON k.source_id = d.source_id AND k.snapshot_no = d.before_no) SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, count(*) FILTER (o.id IS NULL) AS added, count(*) FILTER (n.id IS NULL) AS removed, count(*) FILTER (o.h <> n.h) AS changed, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL) AS shared FROM o FULL JOIN n ON o.source_id = n.source_id AND o.snapshot_no = n.snapshot_no AND o.id = n.id GROUP BY 1, 2",
    "snapshot_validation": """WITH s AS (SELECT source_id || '|' || snapshot_no AS delivery, * FROM snapshot_record), q AS (SELECT source_id, snapshot_no, delivery, count(*) AS n FROM s GROUP BY 1, 2, 3), p AS (SELECT delivery, lag(n) OVER (PARTITION BY source_id ORDER BY snapshot_no) AS before FROM q),
r AS (SELECT delivery, trim(coalesce(id, '')) AS id, trim(coalesce(title, '')) AS title, trim(coalesce(url, '')) AS url FROM s),
i AS (SELECT delivery, id, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT delivery, count(*) AS n_rows, CAST(sum((id = '')::INT) AS BIGINT) AS no_id, CAST(sum((title = '')::INT) AS BIGINT) AS no_title, CAST(sum((url = '')::INT) AS BIGINT) AS no_url, CAST(sum((url <> '' AND NOT regexp_matches(url, '^https?://[^/?#\\s]+'))::INT) AS BIGINT) AS bad_url FROM r GROUP BY 1),
d AS (SELECT delivery, count(*) FILTER (n > 1 AND id <> '') AS duplicate_ids FROM i GROUP BY 1)
SELECT c.*, d.duplicate_ids, array_to_string(list_filter([CASE WHEN n_rows < 3 THEN 'too few rows' END, CASE WHEN no_id > 0 THEN 'missing ids' END, CASE WHEN no_title > 0 THEN 'missing titles' END, CASE WHEN no_url > 0 THEN 'missing urls' END, CASE WHEN bad_url > 0 THEN 'invalid urls' END, CASE WHEN duplicate_ids > 0 THEN 'duplicate ids' END, CASE WHEN n_rows < floor(before * 0.85::DOUBLE) THEN 'row count dropped' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c JOIN d USING (delivery) LEFT JOIN p USING (delivery)""",
    "enriched_validation": "WITH r AS (SELECT * FROM snapshot_record WHERE title_translation_status IS NOT NULL), a AS (SELECT count(*) AS n, count(*) FILTER (length(trim(coalesce(title, ''))) = 0) AS empty_titles, count(*) FILTER (length(trim(coalesce(summary, ''))) = 0) AS empty_summaries, count(*) FILTER (NOT coalesce(sector_code IN ('" + "', '".join([*taxonomy.TOP_LEVEL, taxonomy.OTHER]) + "'), false)) AS invalid_codes, count(*) FILTER (coalesce(regexp_matches(title, '[\\x{0E00}-\\x{0E7F}]'), false)) AS thai_titles FROM r) SELECT *, thai_titles > greatest(3, ceil(n * 0.02::DOUBLE)) AS too_many_thai FROM a",
    "translation_outcomes": "SELECT CASE WHEN length(title_original) % 7 = 0 THEN 'quota_exceeded' WHEN length(title_original) % 11 = 0 THEN 'api_error' WHEN " + " OR ".join(f"contains(upper(coalesce(title, '')), '{m}')" for m in text.TRANSLATION_ERRORS) + " THEN 'quota_exceeded' WHEN trim(coalesce(title, '')) = '' OR lower(trim(title)) = lower(trim(title_original)) THEN 'original_preserved' ELSE 'translated' END AS status, count(*) AS n FROM snapshot_record WHERE title_original IS NOT NULL GROUP BY 1",
    "incremental_pending": "WITH s AS (SELECT source_id, snapshot_no, trim(id) AS id, sha256(coalesce(title, '') || chr(10) || coalesce(summary, '')) AS digest FROM snapshot_record QUALIFY row_number() OVER (PARTITION BY source_id, snapshot_no, trim(id) ORDER BY fetched_at DESC, sha256(coalesce(title, '') || chr(10) || coalesce(summary, '')) DESC) = 1), dl AS (SELECT source_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source_id ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT source_id, snapshot_no FROM snapshot_record)) SELECT n.source_id, n.snapshot_no, n.id, n.digest FROM s n JOIN dl USING (source_id, snapshot_no) LEFT JOIN s o ON o.source_id = n.source_id AND o.snapshot_no = dl.before_no AND o.id = n.id WHERE o.id IS NULL OR o.digest <> n.digest",
    "missing_from_index": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_terms": "SELECT user_id, event_type, round(max(least(1::DOUBLE, greatest(0::DOUBLE, value / 100))), 6) AS relevance, count(*) AS evidence_count, max(ts) AS last_seen FROM events GROUP BY 1, 2",
    "related_terms_topn": "WITH t AS (SELECT user_id, event_type, max(value) AS relevance, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(relevance, 6) DESC, n DESC, event_type) AS INT) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(relevance, 6) DESC, n DESC, event_type) <= 2",
    "related_term_mining": f"WITH n AS (SELECT b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 1 ORDER BY s DESC, b.vec_id LIMIT 10), w AS (SELECT unnest({_words('text', 6, 5)}) AS term, s FROM documents JOIN n USING (doc_id)) SELECT term, max(s) AS relevance FROM w WHERE length(term) BETWEEN 2 AND 80 AND NOT regexp_matches(term, '(?i)(https?://|www\\.|@|(\\+?\\d[\\d ().-]{{7,}}\\d))') GROUP BY 1 ORDER BY relevance DESC, term LIMIT 8",
    "sensitive_text": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(https?://|www\\.|@|(\\+?\\d[\\d ().-]{7,}\\d))')",
    "normalise_and_hash": f"WITH {CAT} SELECT id, sha256({norm('title')}) AS digest FROM cat",
    "stable_ids": f"WITH {CAT} SELECT id, 'rec_' || substr(sha256(url), 1, 16) AS stable_id, md5(url) AS cache_key FROM cat WHERE url IS NOT NULL",
    "keywords_from_title": f"WITH {CAT} SELECT id, coalesce(array_to_string({_words('title', 3, 10)}, '|'), '') AS words FROM cat",
    "document_text_template": f"WITH {CAT} SELECT id, md5({_DOC}) AS digest, CAST(length({_DOC}) AS INT) AS n_chars FROM cat",
    "searchable_length": f"WITH {CAT} SELECT id, CAST(length({SEARCHABLE}) AS INT) AS n_chars FROM cat",
    "url_parts": f"WITH {CAT} SELECT id, regexp_matches(coalesce(url, ''), '^https?://[^/?#\\s]+') AS valid, regexp_extract(coalesce(url, ''), '^https?://([^/?#]+)', 1) AS host, ends_with(lower(regexp_extract(coalesce(url, ''), '^https?://[^/?#]+([^?#]*)', 1)), '.pdf') AS is_pdf FROM cat",
    "html_escape": f"SELECT doc_id, md5({_repaired('text')}) AS digest FROM documents",
    "slugs": f"WITH {CAT} SELECT id, coalesce(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 50), '') AS slug FROM cat",
    "source_initials": "SELECT id, upper(array_to_string(list_transform(list_filter(string_split(coalesce(name, ''), ' '), lambda w: length(w) > 3)[1:2], lambda w: left(w, 1)), '')) AS initials FROM catalogue_source",
    "date_notation": f"WITH {CAT} SELECT id, CASE WHEN regexp_full_match(reg_date, '\\d{{8}}') THEN substr(reg_date, 1, 4) || '-' || substr(reg_date, 5, 2) || '-' || substr(reg_date, 7, 2) ELSE reg_date END AS reg_date, CASE WHEN length(reg_date) = 0 THEN '0' WHEN length(reg_date) <= 20 THEN '1-20' ELSE '21-50' END AS bucket FROM cat WHERE reg_date IS NOT NULL",
    "title_patch": "WITH l AS (SELECT trim(id) AS id, max(title_original) AS listed FROM snapshot_record WHERE length(trim(title_original)) > 0 GROUP BY 1), r AS (SELECT trim(id) AS id, title FROM snapshot_record QUALIFY row_number() OVER (PARTITION BY trim(id) ORDER BY title IS NULL, snapshot_no DESC, fetched_at DESC, title DESC) = 1) SELECT r.id, coalesce(listed, title) AS title FROM r LEFT JOIN l ON l.id = r.id",
    "mapping_integrity": "SELECT 'unknown code' AS problem, code AS value FROM (SELECT unnest(ics_codes) AS code FROM source_sector_map) WHERE code NOT IN (SELECT code FROM ics_sector) UNION ALL SELECT 'preferred twice', preferred_query_for FROM ntb_to_ics WHERE length(trim(preferred_query_for)) > 0 GROUP BY 2 HAVING count(*) > 1",
    "label_code_union": "SELECT lower(source_sector) AS category, array_to_string(ics_codes, '|') AS codes FROM source_sector_map WHERE len(ics_codes) > 0",
    "filter_delta": f"WITH {CAT}, o AS (SELECT id, list_sort(list_distinct(list(sector_code))) AS now FROM sector_override GROUP BY 1) SELECT c.id, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(coalesce(sector_codes, []), x))), '|') AS added, array_to_string(list_sort(list_distinct(list_filter(coalesce(sector_codes, []), lambda x: NOT list_contains(now, x)))), '|') AS removed FROM cat c JOIN o ON o.id = c.id",
    "url_union": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM (SELECT url FROM technology UNION SELECT url FROM snapshot_record) WHERE length(url) > 0 GROUP BY 1",
    "category_counts": f"WITH {CAT} SELECT coalesce(sector, '') AS sector, coalesce(record_type, '') AS record_type, count(*) AS n FROM cat GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in SQL}
