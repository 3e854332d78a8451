"""Search, classification, facets and federation over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import normalised
from lodestar.functions.vectors import l2_normalised, norm as length_of
from lodestar.operators import facets, federation, search, taxonomy
from lodestar.plans.catalogue import CAT, SEARCHABLE, catalogue, norm, searchable
from lodestar.storage import table

QUERY, SECOND_PAGE = "pilot weeks", 2
SELECTED = ["27", "07", "other"]
COUNTRIES = ["Thailand", "Philippines", "India"]
SOURCES = ["harbour_tlo", "krungtech", "luzon_lab", "coral_ip", "monsoon_offers"]
RELATED = ["turbine", "enzyme carrier", "gas sensor"]
#: The vector of this row stands for the query's; similarities among the test vectors are low, so is the threshold.
QUERY_VECTOR, LOW_SCORE = 1, 0.30


def _hits(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return catalogue(spark, d, columns, hit=normalised(searchable()).contains(QUERY)).where("hit")


def search_keyword_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page_of(_hits(spark, d, ["title"]).select("id", "title"), [F.col("id")], SECOND_PAGE)


def search_keyword_count_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, ["source_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def search_source_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    asked = federation.pruned_sources(table(spark, d, "catalogue_source"), include=SOURCES, exclude=["coral_ip"])
    return catalogue(spark, d, ["source_id"]).join(asked.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id", "source_id")


def search_country_prune(spark: SparkSession, d: str) -> DataFrame:
    return federation.pruned_sources(table(spark, d, "catalogue_source"), countries=COUNTRIES).select("id", "country", "multi_country")


def search_sector_prune(spark: SparkSession, d: str) -> DataFrame:
    return federation.pruned_sources(table(spark, d, "catalogue_source"), sectors=["27"]).select("id")


def search_transfer_type(spark: SparkSession, d: str) -> DataFrame:
    return federation.pruned_sources(table(spark, d, "catalogue_source"), transfer_types=["Licence", ""]).select("id", "transfer_type")


def search_sector_filter(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["sector_codes"])
    return cat.where(taxonomy.matches_sectors(F.col("sector_codes"), SELECTED)).select("id", F.array_join(F.coalesce("sector_codes", F.array().cast("array<string>")), "|").alias("codes"))


def search_multi_country_filter(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["country"])
    own = F.split(F.coalesce("country", F.lit("")), ", ")
    return cat.where(F.arrays_overlap(own, F.array(*[F.lit(c) for c in COUNTRIES]))).select("id", "country")


def search_language_postfilter(spark: SparkSession, d: str) -> DataFrame:
    page = search.page_of(_hits(spark, d, ["language"]).select("id", "language"), [F.col("id")], 1)
    return page.where(F.lower("language") == "en").select("id", "total")


def search_failed_sources(spark: SparkSession, d: str) -> DataFrame:
    asked = federation.pruned_sources(table(spark, d, "catalogue_source"), sectors=["27"])
    return federation.with_status(asked, catalogue(spark, d, ["source_id"]), "source_id")


def _query_vector(spark: SparkSession, d: str) -> list[float] | None:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
    return list(row[0]) if row else None


def _scored_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    title = F.substring("text", 1, 40)
    found = search.scored(docs.withColumn("title", title), F.col("title"), F.col("text"), QUERY, RELATED, F.col("embedding"), _query_vector(spark, d), LOW_SCORE)
    return found.where("matches").select("doc_id", "title", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"))


def search_hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored_documents(spark, d).select("doc_id", "semantic", "score")


def search_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scored_documents(spark, d).orderBy(F.col("score").desc(), F.lower("title").desc(), "doc_id").limit(search.PAGE_SIZE).select("doc_id", "score")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    found = search.blocked_similarity(v.where(F.col("vec_id") % 100 == 0), v, "vec_id", "vec_id", "embedding", top=5)
    return found.select(F.col("q").alias("query_id"), F.col("r").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def vector_threshold_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    found = search.blocked_similarity(v.where(F.col("vec_id") % 100 == 0), v, "vec_id", "vec_id", "embedding", least=LOW_SCORE)
    return found.where(F.col("q") != F.col("r")).select(F.col("q").alias("query_id"), F.col("r").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def vector_l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return v.select("vec_id", F.round(length_of(F.col("v")), 6).alias("before"), F.round(length_of(l2_normalised(F.col("v"))), 6).alias("after"))


def sources_inventory(spark: SparkSession, d: str) -> DataFrame:
    per = catalogue(spark, d, ["source_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    src = table(spark, d, "catalogue_source").select("id", "name", "country", F.coalesce("multi_country", F.lit(False)).alias("multi_country"))
    return src.join(per, src.id == per.source_id, "left").select("id", "name", "country", "multi_country", "n")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    cat = catalogue(spark, d, ["source_sector"], found=taxonomy.keyword_codes(text))
    return taxonomy.classified(cat, "source_sector", F.col("found"), table(spark, d, "source_sector_map"))


def classify_records(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("id", F.array_join("codes", "|").alias("codes"), "method", "confidence")


def classify_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = taxonomy.labels_of(taxonomy.known_codes(F.col("codes")))
    return _classified(spark, d).select("id", F.coalesce(F.get(labels, F.lit(0)), F.lit(taxonomy.OTHER_LABEL)).alias("sector"))


def classify_method_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("method", "confidence").agg(F.count(F.lit(1)).alias("n"))


def classify_precedence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshot_record").select("snapshot_no", "source_id", "id", "fetched_at", "title", "summary", "sector_code", "sector_codes", "classification_method", "classification_confidence")
    found = taxonomy.explicit_first(F.col("sector_codes"), F.col("sector_code"), F.col("classification_method"), F.col("classification_confidence"), taxonomy.keyword_codes(F.concat_ws(" ", "title", "summary")))
    return s.select(F.array_join(found["codes"], "|").alias("codes"), found["method"].alias("method"), found["confidence"].alias("confidence")).groupBy("codes", "method", "confidence").agg(F.count(F.lit(1)).alias("n"))


def classify_reviewed(spark: SparkSession, d: str) -> DataFrame:
    reviewed = table(spark, d, "sector_override").groupBy("id").agg(F.min("sector_code").alias("reviewed"))
    cat = catalogue(spark, d, ["sector_codes"])
    return cat.join(reviewed, "id", "left").select("id", F.coalesce("reviewed", F.get("sector_codes", F.lit(0)), F.lit(taxonomy.OTHER)).alias("code"), F.col("reviewed").isNotNull().alias("is_reviewed"))


def classify_code_then_label(spark: SparkSession, d: str) -> DataFrame:
    ntb = table(spark, d, "ntb_to_ics").groupBy("ntb_code").agg(F.max("ics_codes").alias("ics_codes"), F.max("ntb_label").alias("ntb_label"))
    letter = F.char((F.lit(65) + F.col("doc_id") % 26).cast("int"))
    probe = table(spark, d, "documents").select("doc_id", letter.alias("primary"), F.concat(letter, F.char((F.lit(65) + F.col("doc_id") % 23).cast("int"))).alias("middle"))
    a = ntb.select(F.col("ntb_code").alias("middle"), F.col("ics_codes").alias("by_middle"))
    b = ntb.select(F.col("ntb_code").alias("primary"), F.col("ics_codes").alias("by_primary"))
    return probe.join(a, "middle", "left").join(b, "primary", "left").select("doc_id", F.coalesce(F.nullif("by_middle", F.lit("")), F.nullif("by_primary", F.lit(""))).alias("ics_codes"))


def reverse_map_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    codes = catalogue(spark, d, ["sector_codes"]).select(F.explode(F.array_distinct("sector_codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, d, "ics_sector").select(F.col("code").alias("selected"))
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("code", r"\."))), lambda n: F.array_join(F.slice(F.split("code", r"\."), F.lit(1), n), "."))
    return codes.select("code", "n", F.explode(parents).alias("selected")).join(own, "selected").select("selected", "code", "n")


def sector_rollup(spark: SparkSession, d: str) -> DataFrame:
    parents = taxonomy.top_level(F.coalesce("sector_codes", F.array().cast("array<string>")))
    each = F.explode(F.when(F.size(parents) > 0, parents).otherwise(F.array(F.lit(taxonomy.OTHER))))
    return catalogue(spark, d, ["source_id", "sector_codes"]).select("source_id", each.alias("parent")).groupBy("source_id", "parent").agg(F.count(F.lit(1)).alias("n"))


def _facets(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["source_id", "country", "sector_codes"], hit=F.lower(searchable()).contains(QUERY))
    own = F.filter(F.split(F.coalesce("country", F.lit("")), ", "), lambda c: c != "")
    codes = F.coalesce("sector_codes", F.array().cast("array<string>"))
    return facets.facet_counts(cat, F.col("id"), F.col("hit"), F.col("source_id"), own, codes, taxonomy.top_level(codes), SOURCES, COUNTRIES, SELECTED)


def facet_all(spark: SparkSession, d: str) -> DataFrame:
    return _facets(spark, d)


def facet_sector(spark: SparkSession, d: str) -> DataFrame:
    return _facets(spark, d).where(F.col("facet") == "sector").select(F.col("value").alias("sector"), "n")


def facet_country(spark: SparkSession, d: str) -> DataFrame:
    return _facets(spark, d).where(F.col("facet") == "country").select(F.col("value").alias("country"), "n")


def facet_source(spark: SparkSession, d: str) -> DataFrame:
    return _facets(spark, d).where(F.col("facet") == "source").select(F.col("value").alias("source_id"), "n")


def facet_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    domain = table(spark, d, "catalogue_source").select(F.col("id").alias("value"), (F.col("access_method") != "redirect").alias("available"))
    return facets.filled_facets(_facets(spark, d).where(F.col("facet") == "source"), domain)


def facet_transfer_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalogue_source").where(F.length(F.trim("transfer_type")) > 0).select("transfer_type").distinct()


def federated_totals(spark: SparkSession, d: str) -> DataFrame:
    return federation.totals_by_source(catalogue(spark, d, ["source_id"]), "source_id")


def _interleaved(spark: SparkSession, d: str) -> DataFrame:
    ordinals = table(spark, d, "catalogue_source").select(F.col("id").alias("source_id"))
    ordinals = ordinals.join(ordinals.select(F.col("source_id").alias("other")), F.col("other") < F.col("source_id"), "left").groupBy("source_id").agg(F.count("other").alias("ordinal"))
    return search.interleaved(catalogue(spark, d, ["source_id"]).select("id", "source_id"), "source_id", ["id"], ordinals, "ordinal")


def round_robin_full(spark: SparkSession, d: str) -> DataFrame:
    return _interleaved(spark, d).select("id", "source_id", "loc", "pos")


def round_robin_page(spark: SparkSession, d: str) -> DataFrame:
    first = (SECOND_PAGE - 1) * search.PAGE_SIZE
    return _interleaved(spark, d).where((F.col("pos") >= first) & (F.col("pos") < first + search.PAGE_SIZE)).select("id", "source_id", "loc", "pos")


def page_refs_join(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d, ["source_id"]).select("id", "source_id")
    totals = sorted((r[0], r[1]) for r in cat.groupBy("source_id").count().collect() if r[0])
    _, _, refs = search.page_plan(totals, SECOND_PAGE)
    wanted = spark.createDataFrame([(s, int(o), i) for i, (s, o) in enumerate(refs)], "source_id string, loc long, slot int")
    rows = search.distributed_positions(cat, ["source_id"], ["id"], "loc")
    return F.broadcast(wanted).join(rows.select("source_id", F.col("loc").cast("long").alias("loc"), "id"), ["source_id", "loc"], "left").select("slot", "source_id", "loc", "id")


def bounded_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = search.distributed_positions(catalogue(spark, d, ["source_id"]).select("id", "source_id"), ["source_id"], ["id"], "loc")
    return rows.where(F.col("loc") < 10).select("source_id", "id")


def stats_bar(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["source_id", "country"]).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("source_id").alias("n_sources"), F.count_distinct(F.nullif("country", F.lit(""))).alias("n_countries"))


_RULES_SQL = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(txt, '{t}')" for t in terms) + f" THEN '{code}' END" for code, terms in taxonomy.KEYWORD_RULES) + "], lambda x: x IS NOT NULL)[1:3]"
_TXT = "lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(array_to_string(keywords, ' '), ''))"
_CLASSIFIED = f"""WITH {CAT}, m AS (SELECT lower(trim(source_sector)) AS s, max(ics_codes) AS codes FROM source_sector_map GROUP BY 1),
t AS (SELECT id, trim(regexp_replace(lower(coalesce(source_sector, '')), '\\s+', ' ', 'g')) AS s, {_TXT} AS txt FROM cat),
r AS (SELECT id, t.s, m.codes AS mapped, {_RULES_SQL} AS found FROM t LEFT JOIN m ON m.s = t.s),
c AS (SELECT id, CASE WHEN len(coalesce(mapped, [])) > 0 THEN mapped ELSE found END AS codes,
 CASE WHEN len(coalesce(mapped, [])) > 0 THEN 'source_mapping' WHEN len(found) > 0 THEN CASE WHEN s = 'materials' THEN 'keyword_mapping' ELSE 'keyword_fallback' END ELSE 'unclassified' END AS method,
 CASE WHEN len(coalesce(mapped, [])) > 0 THEN 'high' WHEN len(found) > 0 AND s = 'materials' THEN 'medium' ELSE 'low' END AS confidence FROM r)"""
_LABEL_SQL = "CASE " + " ".join(f"WHEN k = '{c}' THEN '{v}'" for c, v in taxonomy.LABELS.items()) + " END"
_TOP = "(" + ", ".join(f"'{c}'" for c in taxonomy.TOP_LEVEL) + ")"
_ALL = "(" + ", ".join(f"'{c}'" for c in taxonomy.LABELS) + ")"
_IN_SECTOR = "(len(coalesce(sector_codes, [])) = 0 OR len(list_filter(coalesce(sector_codes, []), lambda c: c IN ('27', '07') OR starts_with(c, '27.') OR starts_with(c, '07.'))) > 0)"
_IN_COUNTRY = "len(list_filter(string_split(coalesce(country, ''), ', '), lambda c: c IN ('Thailand', 'Philippines', 'India'))) > 0"
_IN_SOURCE = "source_id IN ('harbour_tlo', 'krungtech', 'luzon_lab', 'coral_ip', 'monsoon_offers')"
_PARENTS = f"list_distinct(list_filter(list_transform(coalesce(sector_codes, []), lambda c: split_part(c, '.', 1)), lambda c: c IN {_TOP}))"
_FACET = f"""WITH {CAT}, h AS (SELECT *, {_IN_SECTOR} AS m_sec, coalesce({_IN_COUNTRY}, false) AS m_cty, coalesce({_IN_SOURCE}, false) AS m_src FROM cat WHERE contains(lower({SEARCHABLE}), 'pilot weeks')),
f AS (SELECT 'source' AS facet, source_id AS value FROM h WHERE m_cty AND m_sec
 UNION ALL SELECT 'country', unnest(list_distinct(list_filter(string_split(coalesce(country, ''), ', '), lambda c: c <> ''))) FROM h WHERE m_src AND m_sec
 UNION ALL SELECT 'sector', unnest(CASE WHEN len({_PARENTS}) > 0 THEN {_PARENTS} ELSE ['other'] END) FROM h WHERE m_src AND m_cty),
g AS (SELECT facet, value, count(*) AS n FROM f GROUP BY 1, 2)"""
_HITS = f"{CAT}, hits AS (SELECT * FROM cat WHERE contains({norm(SEARCHABLE)}, 'pilot weeks'))"
_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_SCORE = f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 1),
s AS (SELECT d.doc_id, substr(d.text, 1, 40) AS title, {norm('d.text')} AS txt, {norm('substr(d.text, 1, 40)')} AS head,
 coalesce(list_inner_product(e.embedding::DOUBLE[], (SELECT qv FROM q)::DOUBLE[]), 0::DOUBLE) AS sem FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
r AS (SELECT *, contains(txt, 'pilot weeks') AS ex, contains(head, 'pilot weeks') AS th, (contains(txt, 'turbine')::INT + contains(txt, 'enzyme carrier')::INT + contains(txt, 'gas sensor')::INT) AS rel FROM s),
z AS (SELECT doc_id, title, round(sem, 6) AS semantic, round(sem * 0.60::DOUBLE + (CASE WHEN ex OR th THEN 1 ELSE 0 END)::DOUBLE * 0.30::DOUBLE + least(1::DOUBLE, rel / 2.0::DOUBLE) * 0.10::DOUBLE + (CASE WHEN th THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS score FROM r WHERE ex OR rel > 0 OR sem >= 0.30::DOUBLE)"""
_RR = f"""WITH {CAT}, o AS (SELECT id AS source_id, row_number() OVER (ORDER BY id) AS ord FROM catalogue_source),
l AS (SELECT c.id, c.source_id, o.ord, row_number() OVER (PARTITION BY c.source_id ORDER BY c.id) - 1 AS loc FROM cat c JOIN o ON o.source_id = c.source_id),
p AS (SELECT id, source_id, loc, row_number() OVER (ORDER BY loc, ord) - 1 AS pos FROM l)"""
_PRUNE = "SELECT id{0} FROM catalogue_source WHERE {1}"
SQL = {
    "search_keyword_page": f"WITH {_HITS} SELECT id, title, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY id LIMIT 20 OFFSET 20",
    "search_keyword_count_by_source": f"WITH {_HITS} SELECT source_id, count(*) AS n FROM hits GROUP BY 1",
    "search_source_include_exclude": f"WITH {CAT} SELECT id, source_id FROM cat WHERE {_IN_SOURCE} AND source_id <> 'coral_ip' AND source_id IN (SELECT id FROM catalogue_source)",
    "search_country_prune": _PRUNE.format(", country, multi_country", "country IN ('Thailand', 'Philippines', 'India', 'Global') OR multi_country"),
    "search_sector_prune": _PRUNE.format("", "sector_filter_supported"),
    "search_transfer_type": _PRUNE.format(", transfer_type", "transfer_type IN ('Licence')"),
    "search_sector_filter": f"WITH {CAT} SELECT id, coalesce(array_to_string(sector_codes, '|'), '') AS codes FROM cat WHERE {_IN_SECTOR}",
    "search_multi_country_filter": f"WITH {CAT} SELECT id, country FROM cat WHERE {_IN_COUNTRY}",
    "search_language_postfilter": f"WITH {_HITS}, pg AS (SELECT id, language, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY id LIMIT 20) SELECT id, total FROM pg WHERE lower(language) = 'en'",
    "search_failed_sources": f"WITH {CAT} SELECT id AS source_id, CASE WHEN id IN (SELECT source_id FROM cat WHERE source_id IS NOT NULL) THEN 'ok' ELSE 'failed' END AS status FROM catalogue_source WHERE sector_filter_supported",
    "search_hybrid_score": _SCORE + " SELECT doc_id, semantic, score FROM z",
    "search_hybrid_topk": _SCORE + " SELECT doc_id, score FROM z ORDER BY score DESC, lower(title) DESC, doc_id LIMIT 20",
    "vector_topk": f"SELECT a.vec_id AS query_id, b.vec_id, round({_DOT}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) <= 5",
    "vector_threshold_pairs": f"SELECT a.vec_id AS query_id, b.vec_id, round({_DOT}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND round({_DOT}, 6) >= 0.30",
    "vector_l2_normalise": "SELECT vec_id, round(3 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS before, CASE WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END AS after FROM embeddings",
    "sources_inventory": f"WITH {CAT}, p AS (SELECT source_id, count(*) AS n FROM cat GROUP BY 1) SELECT s.id, s.name, s.country, coalesce(s.multi_country, false) AS multi_country, p.n FROM catalogue_source s LEFT JOIN p ON p.source_id = s.id",
    "classify_records": _CLASSIFIED + " SELECT id, array_to_string(codes, '|') AS codes, method, confidence FROM c",
    "classify_labels": _CLASSIFIED + f" , k AS (SELECT id, list_filter(codes, lambda x: x IN {_ALL})[1] AS k FROM c) SELECT id, coalesce({_LABEL_SQL}, 'Other / Unclassified') AS sector FROM k",
    "classify_method_counts": _CLASSIFIED + " SELECT method, confidence, count(*) AS n FROM c GROUP BY 1, 2",
    "classify_precedence": f"""WITH t AS (SELECT *, lower(concat_ws(' ', title, summary)) AS txt, list_distinct(list_filter(list_transform(coalesce(sector_codes, []), lambda c: trim(c)), lambda c: c IN {_ALL})) AS u,
  list_filter(list_transform(coalesce(sector_codes, []), lambda c: trim(c)), lambda c: c IN {_ALL}) AS raw, trim(coalesce(sector_code, '')) AS one FROM snapshot_record),
r AS (SELECT *, list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda p: list_position(raw, p[1]) = p[2]), lambda p: p[1]) AS listed, {_RULES_SQL} AS found,
  CASE WHEN coalesce(classification_confidence, 'high') IN ('high', 'medium', 'low') THEN coalesce(classification_confidence, 'high') ELSE 'low' END AS sure FROM t),
c AS (SELECT CASE WHEN len(listed) > 0 THEN listed WHEN one IN {_TOP} THEN [one] WHEN one = 'other' THEN []::VARCHAR[] ELSE found END AS cs,
  CASE WHEN len(listed) > 0 THEN coalesce(classification_method, 'indexed_sector_codes') WHEN one IN {_TOP} THEN coalesce(classification_method, 'indexed_sector_code') WHEN one = 'other' THEN coalesce(classification_method, 'indexed_unclassified') WHEN len(found) > 0 THEN 'keyword_fallback' ELSE 'unclassified' END AS method,
  CASE WHEN len(listed) > 0 OR one IN {_TOP} THEN sure ELSE 'low' END AS confidence FROM r)
SELECT array_to_string(cs, '|') AS codes, method, confidence, count(*) AS n FROM c GROUP BY 1, 2, 3""",
    "classify_reviewed": f"WITH {CAT}, o AS (SELECT id, min(sector_code) AS reviewed FROM sector_override GROUP BY 1) SELECT c.id, coalesce(o.reviewed, c.sector_codes[1], 'other') AS code, o.reviewed IS NOT NULL AS is_reviewed FROM cat c LEFT JOIN o ON o.id = c.id",
    "classify_code_then_label": "WITH p AS (SELECT doc_id, chr((65 + doc_id % 26)::INT) AS pri, chr((65 + doc_id % 26)::INT) || chr((65 + doc_id % 23)::INT) AS mid FROM documents), n AS (SELECT ntb_code, max(ics_codes) AS ics_codes FROM ntb_to_ics GROUP BY 1) SELECT doc_id, coalesce(nullif(a.ics_codes, ''), nullif(b.ics_codes, '')) AS ics_codes FROM p LEFT JOIN n a ON a.ntb_code = mid LEFT JOIN n b ON b.ntb_code = pri",
    "reverse_map_prefix_join": f"WITH {CAT}, c AS (SELECT code, count(*) AS n FROM (SELECT id, unnest(list_distinct(sector_codes)) AS code FROM cat) GROUP BY 1) SELECT s.code AS selected, c.code, c.n FROM c JOIN ics_sector s ON c.code = s.code OR starts_with(c.code, s.code || '.')",
    "sector_rollup": f"WITH {CAT} SELECT source_id, parent, count(*) AS n FROM (SELECT source_id, unnest(CASE WHEN len({_PARENTS}) > 0 THEN {_PARENTS} ELSE ['other'] END) AS parent FROM cat) GROUP BY 1, 2",
    "facet_all": _FACET + " SELECT facet, value, n FROM g",
    "facet_sector": _FACET + " SELECT value AS sector, n FROM g WHERE facet = 'sector'",
    "facet_country": _FACET + " SELECT value AS country, n FROM g WHERE facet = 'country'",
    "facet_source": _FACET + " SELECT value AS source_id, n FROM g WHERE facet = 'source'",
    "facet_zero_fill": _FACET + " SELECT s.id AS value, CASE WHEN s.access_method <> 'redirect' THEN coalesce(g.n, 0) END AS n FROM catalogue_source s LEFT JOIN g ON g.facet = 'source' AND g.value = s.id",
    "facet_transfer_types": "SELECT DISTINCT transfer_type FROM catalogue_source WHERE length(trim(transfer_type)) > 0",
    "federated_totals": f"WITH {CAT} SELECT source_id, count(*) AS total, CAST(sum(count(*)) OVER () AS BIGINT) AS grand_total FROM cat GROUP BY 1",
    "round_robin_full": _RR + " SELECT * FROM p",
    "round_robin_page": _RR + " SELECT * FROM p WHERE pos >= 20 AND pos < 40",
    "page_refs_join": f"WITH {CAT}, l AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS loc FROM cat WHERE source_id <> ''), p AS (SELECT *, row_number() OVER (ORDER BY loc, source_id) - 1 AS pos FROM l) SELECT CAST(pos - 20 AS INT) AS slot, source_id, loc, id FROM p WHERE pos >= 20 AND pos < 40",
    "bounded_per_group": f"WITH {CAT} SELECT source_id, id FROM cat QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) <= 10",
    "stats_bar": f"WITH {CAT} SELECT count(*) AS n_records, count(DISTINCT source_id) AS n_sources, count(DISTINCT nullif(country, '')) AS n_countries FROM cat",
}
QUERIES = {name: globals()[name] for name in SQL}
