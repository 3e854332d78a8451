"""Queries of the operators on text, and the SQL some of them can be checked against."""

from __future__ import annotations

from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, leakage, mixing, names, residue, sentences, subjects, truncation
from lodestar.operators.snapshots import trimmed_id
from lodestar.storage import table

#: Labelled rows that language models and subject terms are fitted on, at most.
LANGUAGE_ROWS, SUBJECT_ROWS = 2_000, 8_000
#: Rows of a small fixed table that may come to the driver, at most.
FIXED_ROWS = 10_000


def fixed_rows(df: DataFrame) -> list:
    """All rows of a table that is fixed in size; more than expected is an error, not a crash later."""
    rows = df.limit(FIXED_ROWS + 1).collect()
    if len(rows) > FIXED_ROWS:
        raise ValueError(f"a fixed table has more than {FIXED_ROWS} rows")
    return rows


def bounded_sample(df: DataFrame, key: str, columns: list[str], most: int) -> list:
    """At most ``most`` rows spread over the table by a hash of the key, for fitting only."""
    total = max(1, df.count())
    per_million = max(1, round(1_000_000 * most * 0.9 / total))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < per_million).select(*columns).limit(most).collect()


def language_model(spark: SparkSession, d: str) -> Broadcast:
    """Models fitted on the labelled sentences, then refitted with sentences of a bounded sample of documents that the first models and the stored label agree on."""
    seed = [(r[0], r[1]) for r in fixed_rows(table(spark, d, "lang_sample").select("lang", "text"))]
    seed = [(langid.label_code(lang) or lang, t) for lang, t in seed if lang and t]
    first = langid.fit_language_model(seed)
    scorer = langid.Scorer(first)
    place = {lang: i for i, lang in enumerate(first.languages)}
    more = []
    for text, label in bounded_sample(table(spark, d, "documents"), "doc_id", ["text", "lang"], LANGUAGE_ROWS):
        i = place.get(langid.label_code(label))
        units = [text[a:b] for a, b in sentences.sentence_spans(text)] if i is not None and text else []
        if units:
            cost, _ = scorer.costs_of([u.lower() for u in units])
            best = cost.argmin(axis=1)
            agreed = sum(len(u) for u, b in zip(units, best) if b == i)
            if agreed >= 0.8 * sum(map(len, units)):
                more += [(first.languages[i], u) for u, c in zip(units, cost) if c[i] - c.min() < 40]
    return spark.sparkContext.broadcast(langid.fit_with_limit(seed, more))


def _residue_of(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    return residue.template_residue(table(spark, d, "technology"), "id", fields, "source_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rec_key"), "text", "lang")


def _technologies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "technology").where(F.length(F.trim("summary")) > 0)
    return t.select(F.col("id").alias("rec_key"), F.col("summary").alias("text"), F.col("language").alias("lang"))


def _without_residue(found: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    bad = _residue_of(spark, d, ["summary"]).select(F.col("id").alias("rec_key"))
    return found.join(bad, "rec_key", "left_anti")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """The latest original title of every snapshot id."""
    s = table(spark, d, "snapshot_record").where(F.length(F.trim("title_original")) > 0)
    return s.groupBy(trimmed_id(F.col("id")).alias("rec_key")).agg(F.max_by("title_original", F.struct("snapshot_no", "fetched_at", "title_original")).alias("text"))


def _by_table(parts: list[tuple[str, DataFrame]], *columns) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(F.lit(t).alias("rec_table"), *columns) for t, p in parts])


def _segments(spark: SparkSession, d: str, columns: list[str], only_cases: bool) -> DataFrame:
    """Language segments of documents, technology summaries less residue, and snapshot titles; cases name the closest language also where it is rejected."""
    model = language_model(spark, d)
    docs = langid.identify(_documents(spark, d), "rec_key", "text", "lang", model, only_cases=only_cases, closest=only_cases)
    techs = langid.identify(_technologies(spark, d), "rec_key", "text", "lang", model, only_cases=only_cases, closest=only_cases)
    named = langid.identify(_titles(spark, d), "rec_key", "text", None, model, whole=True, closest=only_cases)
    return _by_table([("technology", _without_residue(techs.select(*columns).distinct(), spark, d)), ("documents", docs), ("snapshot_record", named)], *columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, ["rec_key", "seg_no", "lang"], True)


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every language segment of every text with offsets and confidence; a segment in none of the known languages has a null language and confidence 0."""
    return _segments(spark, d, ["rec_key", "seg_no", "start_char", "end_char", "lang", "confidence", "mixed"], False)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "technology"), "id", "summary", "source_id").where("truncated").select("id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(truncation.truncated(table(spark, d, "technology"), "id", "summary", "source_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue_of(spark, d, ["title", "summary"])


def subject_terms(spark: SparkSession, d: str) -> Broadcast:
    """Terms curated from a bounded sample of records with their unreliable codes; a reviewed subject replaces missing codes."""
    codes = {r[0] for r in fixed_rows(table(spark, d, "ics_sector").select("code"))} - {"07"}
    reviewed = table(spark, d, "sector_override").groupBy("id").agg(F.min("sector_code").alias("reviewed"))
    labelled = table(spark, d, "technology").where(F.length(F.trim("summary")) > 0).select("id", "title", "summary", "sector_codes")
    sample = labelled.where(F.size(F.coalesce("sector_codes", F.array())) > 0)
    rows = bounded_sample(sample, "id", ["title", "summary", "sector_codes"], SUBJECT_ROWS)
    extra = labelled.where(F.size(F.coalesce("sector_codes", F.array())) == 0).join(reviewed, "id").select("title", "summary", F.array("reviewed")).limit(SUBJECT_ROWS // 10).collect()
    fitted = subjects.curate_terms([((r[0] or "") + ". " + (r[1] or ""), list(r[2] or ())) for r in [*rows, *extra]], codes)
    return spark.sparkContext.broadcast(fitted)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """(rec_table, rec_key, ics_code, score) of documents and of technology records less residue; repeated rows of a record count once."""
    terms = subject_terms(spark, d)
    docs = subjects.assign_subjects(_documents(spark, d), "rec_key", "text", terms)
    techs = subjects.assign_subjects(_technologies(spark, d), "rec_key", "text", terms).groupBy("rec_key", "subject").agg(F.max("score").alias("score"))
    return _by_table([("technology", _without_residue(techs, spark, d)), ("documents", docs)], "rec_key", F.col("subject").alias("ics_code"), "score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("rec_table", "rec_key", "ics_code")


def p6_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the catalogue by subject, for documents and technology records: their number and their summed shares."""
    return _subjects(spark, d).groupBy("rec_table", "ics_code").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("score"), 3).alias("weight"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    nicknames = [(r[0], r[1]) for r in fixed_rows(table(spark, d, "nickname").select("given", "nick"))]
    return names.link_names(table(spark, d, "technology"), "org_name", nicknames)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_linked(spark, d))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its class: one row per distinct name."""
    return _linked(spark, d)


def _items(spark: SparkSession, d: str) -> Broadcast:
    rows = fixed_rows(table(spark, d, "eval_item").select("item_id", "text"))
    return spark.sparkContext.broadcast(leakage.index_items([(r[0], r[1]) for r in rows]))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", _items(spark, d)).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: number of documents that hold each, and the largest share held."""
    found = leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", _items(spark, d))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("share").alias("most"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with the number of copies of each."""
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target")).selection


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target")).shares


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_segments, p3_found, p3_rates, p4_found, p6_found, p6_composition, p7_found, p7_entities, p8_found, p8_report, p9_selection, p9_shares, p10_found)}
#: None of these has a SQL form that DuckDB could run over whole tables; tests check them
#: against brute force, exact round trips and held-out accuracy instead.
SQL: dict[str, str] = {}
