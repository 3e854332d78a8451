"""Provider categories and native codes mapped to sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import mappings, taxonomy
from lodestar.plans.catalogue import CAT, catalogue
from lodestar.plans.search_queries import _RULES_SQL
from lodestar.storage import table


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


#: Groups, slugs, categories and words that records are given in turn: all known ones and some unknown.
GROUPS = [*mappings.BRACKET_GROUPS, "nothing known", " Energy "]
SLUGS, LAST = [*mappings.PATH_CATEGORIES, "elsewhere"], [*mappings.REVIEWED_SLUGS, *[f"other-{i}" for i in range(20)]]
LINKS, WORDS = ["Food", "Environment", "Herbal", "Herbal", "Else"], ["Tea", "burn Cream", "soap", "Fruit jam", "TABLET", "x"]
PRODUCTS = [*mappings.PRODUCT_CATEGORIES, "Unknown", ""]
STATUSES = ["พร้อมถ่ายทอด", "Prototype ready", "trl 7", "TRL-4 pilot", "INITIAL", "-", "ขั้นทดลอง"]


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def map_patent_category(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d, ["keywords"]).select("id", mappings.patent_sector(F.col("keywords")).alias("sector"))


def map_listing_terms(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    return catalogue(spark, d, [], listing=mappings.first_rule(low, mappings.LISTING_TERMS, mappings.NOTHING), section=mappings.first_rule(low, mappings.SECTION_TERMS, mappings.NOTHING)).select("id", "listing", "section")


def map_bracket_groups(spark: SparkSession, d: str) -> DataFrame:
    uses = F.array(F.concat(F.lit("Use of it [ "), _pick(GROUPS, F.col("doc_id") * 7), F.lit(" ]")), F.concat(F.lit("Other [no group] ["), F.upper(_pick(GROUPS, F.col("doc_id"))), F.lit("]")))
    words = F.get(taxonomy.keyword_codes(F.col("text")), F.lit(0))
    code = mappings.bracket_code(uses)
    return _numbered(spark, d).select("doc_id", F.coalesce(code, words, F.lit(taxonomy.OTHER)).alias("code"), F.when(code.isNotNull(), "high").otherwise("low").alias("confidence"))


def map_path_category(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://x.example/technologies/"), _pick(SLUGS, F.col("doc_id")), F.lit("/"), _pick(LAST, F.col("doc_id") * 5))
    return _numbered(spark, d).select("doc_id", mappings.path_category(url).alias("x")).select("doc_id", "x.sector", "x.code", "x.method")


def map_link_category(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("The "), _pick(WORDS, F.col("doc_id") * 5 + 1))
    return _numbered(spark, d).select("doc_id", mappings.link_category(_pick(LINKS, F.col("doc_id")), title).alias("x")).select("doc_id", "x.code", "x.confidence")


def map_product_categories(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array(_pick(PRODUCTS, F.col("doc_id")), F.concat(F.lit(" "), _pick(PRODUCTS, F.col("doc_id") * 3 + 5), F.lit("  ")), _pick(PRODUCTS, F.col("doc_id") * 11 + 2))
    return _numbered(spark, d).select("doc_id", F.array_join(mappings.product_codes(listed), "|").alias("codes"))


def development_status(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("doc_id", mappings.development_status(F.concat(F.lit("Status: "), _pick(STATUSES, F.col("doc_id")))).alias("status"))


def _native_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with native codes (a third, letters made from the number), official labels (a third) or neither."""
    labels = table(spark, d, "ntb_to_ics").select("ntb_label").where(F.length(F.trim("ntb_label")) > 0).distinct()
    labels = labels.withColumn("at", F.row_number().over(Window.orderBy("ntb_label")) - 1)
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    n_doc, third = F.col("doc_id"), F.col("doc_id") % 3
    letter = F.char((F.lit(65) + n_doc % 26).cast("int"))
    rows = _numbered(spark, d).crossJoin(F.broadcast(n)).withColumn("at", F.when(third == 1, n_doc % F.greatest("n", F.lit(1))))
    rows = rows.join(labels, "at", "left")
    text = F.when(third == 0, letter).otherwise("")
    return rows.select("doc_id", "text", text.alias("primary_code"), F.when(third == 0, F.concat(letter, F.char((F.lit(65) + n_doc % 23).cast("int")))).otherwise("").alias("middle_code"), F.coalesce(F.when(n_doc % 2 == 0, F.col("ntb_label")), F.lit("")).alias("middle_name"), F.coalesce(F.when(n_doc % 2 == 1, F.col("ntb_label")), F.when(third == 2, "Materials"), F.lit("")).alias("primary_name"))


def classify_native(spark: SparkSession, d: str) -> DataFrame:
    natives = mappings.native_codes(table(spark, d, "ntb_to_ics"))
    found = mappings.native_classified(_native_rows(spark, d), "middle_code", "primary_code", "middle_name", "primary_name", taxonomy.keyword_codes(F.col("text")), natives, table(spark, d, "source_sector_map"))
    return found.select("doc_id", F.array_join("codes", "|").alias("codes"), "method", "confidence")


def native_query_codes(spark: SparkSession, d: str) -> DataFrame:
    return mappings.native_query_codes(table(spark, d, "ics_sector").select(F.col("code").alias("selected")), mappings.native_codes(table(spark, d, "ntb_to_ics")))


def _rules(x: str, rules: list, default: str | None) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({x}, '{t}')" for t in terms) + f" THEN '{v}'" for v, terms in rules)
    return f"CASE {cases} ELSE " + (f"'{default}'" if default else "NULL") + " END"


def _lookup(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_LOW = "lower(concat_ws(' ', title, summary))"
_A, _B = _pick_sql(GROUPS, "doc_id * 7"), _pick_sql(GROUPS, "doc_id")
_GROUP = f"coalesce({_lookup(f'lower(trim({_A}))', mappings.BRACKET_GROUPS)}, {_lookup(f'lower(trim({_B}))', mappings.BRACKET_GROUPS)})"
_SLUG, _LAST = _pick_sql(SLUGS, "doc_id"), _pick_sql(LAST, "doc_id * 5")
_REVIEWED, _OWN = _lookup(_LAST, mappings.REVIEWED_SLUGS), _lookup(_SLUG, {k: v[1] for k, v in mappings.PATH_CATEGORIES.items() if v[1]})
_LINK, _TITLE = _pick_sql(LINKS, "doc_id"), f"lower('The ' || {_pick_sql(WORDS, 'doc_id * 5 + 1')})"
_CODES_OF = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mappings.PRODUCT_CATEGORIES.items()) + " ELSE [] END"
_STATUS = f"'Status: ' || {_pick_sql(STATUSES, 'doc_id')}"
_TEXT_RULES = _RULES_SQL.replace("contains(txt", "contains(lower(coalesce(text, ''))")
_NATIVE = r"n AS (SELECT ntb_code, max(ntb_label) AS ntb_label, max(nullif(trim(preferred_query_for), '')) AS preferred, max(list_distinct(regexp_extract_all(ics_codes, '\d\d(?:\.\d+)?'))) AS unordered, max(regexp_extract_all(ics_codes, '\d\d(?:\.\d+)?')) AS raw FROM ntb_to_ics GROUP BY 1), nat AS (SELECT ntb_code, ntb_label, preferred, list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda p: list_position(raw, p[1]) = p[2]), lambda p: p[1]) AS codes FROM n WHERE len(raw) > 0)"
SQL = {
    "map_patent_category": f"WITH {CAT} SELECT id, {_rules('upper(coalesce(array_to_string(keywords, chr(32)), chr(32)))', [(v, [k]) for k, v in mappings.PATENT_CATEGORIES], mappings.NOTHING)} AS sector FROM cat",
    "map_listing_terms": f"WITH {CAT} SELECT id, {_rules(_LOW, mappings.LISTING_TERMS, mappings.NOTHING)} AS listing, {_rules(_LOW, mappings.SECTION_TERMS, mappings.NOTHING)} AS section FROM cat",
    "map_bracket_groups": f"SELECT doc_id, coalesce({_GROUP}, {_TEXT_RULES}[1], 'other') AS code, CASE WHEN {_GROUP} IS NULL THEN 'low' ELSE 'high' END AS confidence FROM documents",
    "map_path_category": f"SELECT doc_id, coalesce({_lookup(_SLUG, {k: v[0] for k, v in mappings.PATH_CATEGORIES.items()})}, '{taxonomy.OTHER_LABEL}') AS sector, coalesce({_REVIEWED}, {_OWN}) AS code, CASE WHEN {_REVIEWED} IS NOT NULL THEN 'reviewed_record' WHEN {_OWN} IS NOT NULL THEN 'category' ELSE 'content_fallback' END AS method FROM documents",
    "map_link_category": f"SELECT doc_id, CASE {_LINK} WHEN 'Food' THEN '67' WHEN 'Environment' THEN '13' WHEN 'Herbal' THEN coalesce({_rules(_TITLE, mappings.HERBAL_TERMS, None)}, '71') ELSE 'other' END AS code, CASE {_LINK} WHEN 'Herbal' THEN 'medium' WHEN 'Else' THEN 'low' ELSE 'high' END AS confidence FROM documents",
    "map_product_categories": f"WITH l AS (SELECT doc_id, flatten(list_transform([{_pick_sql(PRODUCTS, 'doc_id')}, {_pick_sql(PRODUCTS, 'doc_id * 3 + 5')}, {_pick_sql(PRODUCTS, 'doc_id * 11 + 2')}], lambda c: {_CODES_OF})) AS raw FROM documents) SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda p: list_position(raw, p[1]) = p[2]), lambda p: p[1])[1:3], '|') AS codes FROM l",
    "development_status": f"SELECT doc_id, coalesce({_rules(f'lower({_STATUS})', [(v, [k]) for k, v in mappings.STATUS_MARKERS], None)}, CASE WHEN regexp_matches({_STATUS}, '(?i)TRL[-\\s]*\\d') THEN 'TRL-' || regexp_extract({_STATUS}, '(?i)TRL[-\\s]*(\\d)', 1) END, '') AS status FROM documents",
    "classify_native": f"""WITH {_NATIVE}, lab AS (SELECT ntb_label, row_number() OVER (ORDER BY ntb_label) - 1 AS at FROM (SELECT DISTINCT ntb_label FROM ntb_to_ics WHERE length(trim(ntb_label)) > 0)),
r AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN chr((65 + doc_id % 26)::INT) END AS pri, CASE WHEN doc_id % 3 = 0 THEN chr((65 + doc_id % 26)::INT) || chr((65 + doc_id % 23)::INT) END AS mid, l.ntb_label AS label FROM documents d LEFT JOIN lab l ON d.doc_id % 3 = 1 AND l.at = d.doc_id % (SELECT count(*) FROM lab)),
x AS (SELECT doc_id, doc_id % 3 = 2 AND doc_id % 2 = 1 OR doc_id % 3 = 2 AS mat, coalesce(a.codes, b.codes) AS coded, c.codes AS labelled, list_filter({_TEXT_RULES}, lambda q: true) AS found FROM r LEFT JOIN nat a ON a.ntb_code = mid LEFT JOIN nat b ON b.ntb_code = pri LEFT JOIN (SELECT trim(ntb_label) AS ntb_label, min(codes) AS codes FROM nat GROUP BY 1) c ON c.ntb_label = trim(label)),
m AS (SELECT max(ics_codes) AS mapped FROM source_sector_map WHERE lower(trim(source_sector)) = 'materials')
SELECT doc_id, array_to_string(coalesce(coded, labelled, CASE WHEN mat AND len(coalesce(mapped, [])) > 0 THEN mapped ELSE found END), '|') AS codes,
 CASE WHEN coded IS NOT NULL THEN 'native_code' WHEN labelled IS NOT NULL THEN 'native_label' WHEN mat AND len(coalesce(mapped, [])) > 0 THEN 'source_mapping' WHEN len(found) > 0 THEN CASE WHEN mat THEN 'keyword_mapping' ELSE 'keyword_fallback' END ELSE 'unclassified' END AS method,
 CASE WHEN coded IS NOT NULL OR labelled IS NOT NULL OR mat AND len(coalesce(mapped, [])) > 0 THEN 'high' WHEN len(found) > 0 AND mat THEN 'medium' ELSE 'low' END AS confidence FROM x, m""",
    "native_query_codes": f"WITH {_NATIVE} SELECT DISTINCT s.code AS selected, ntb_code AS native_code FROM ics_sector s JOIN nat ON preferred = s.code OR starts_with(preferred, s.code || '.')",
}
QUERIES = {name: globals()[name] for name in SQL}
