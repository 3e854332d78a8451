"""Validation, duplicates, upserts and incremental maintenance of snapshots and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import is_valid_url
from lodestar.operators.records import latest_per_key
from lodestar.operators.search import distributed_positions


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key in an order, by hash aggregation with map-side combine."""
    names = [c for c in keep if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__kept"))
    return picked.select(*keys, *[F.col("__kept").getField(c).alias(c) for c in names])


def richest_per_key(df: DataFrame, keys: list[str], text: str, order: str, keep: list[str]) -> DataFrame:
    """Of rows with one key the one with the longest text; the first one on ties."""
    return first_per_key(df, keys, [-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(order)], keep)


def validated(df: DataFrame, group: str, id_col: str, title: str, url: str, least: int, previous: DataFrame | None = None, most_drop: float = 0.15) -> DataFrame:
    """One row per group with the counts a publication is judged by, and ``errors``.

    Missing ids, titles and URLs, invalid URLs, duplicate ids, too few rows, and a drop
    against the previous count by more than ``most_drop``.
    """

    def blank(c: str) -> Column:
        return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0

    per_id = df.groupBy(group, id_col).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("long")).alias(a) for a, x in (("no_id", blank(id_col)), ("no_title", blank(title)), ("no_url", blank(url)), ("bad_url", ~blank(url) & ~is_valid_url(F.col(url))))])
    per = per_id.groupBy(group).agg(F.sum("n").alias("n_rows"), F.sum("no_id").alias("no_id"), F.sum("no_title").alias("no_title"), F.sum("no_url").alias("no_url"), F.sum("bad_url").alias("bad_url"), F.sum(F.when((F.col("n") > 1) & (F.col("no_id") == 0), 1).otherwise(0)).cast("long").alias("duplicate_ids"))
    per = per.join(previous.select(group, F.col("n_rows").alias("before")), group, "left") if previous is not None else per.withColumn("before", F.lit(None).cast("long"))
    dropped = F.col("n_rows") < F.floor(F.col("before") * (1 - most_drop))
    tests = [(F.col("n_rows") < least, "too few rows"), (F.col("no_id") > 0, "missing ids"), (F.col("no_title") > 0, "missing titles"), (F.col("no_url") > 0, "missing urls"), (F.col("bad_url") > 0, "invalid urls"), (F.col("duplicate_ids") > 0, "duplicate ids"), (F.coalesce(dropped, F.lit(False)), "row count dropped")]
    return per.withColumn("errors", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests])), "; ")).drop("before")


def duplicates(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(kind, value, n) of values that occur more than once, for several fields in one aggregation."""
    tagged = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in fields.items()]))
    return df.select(tagged.alias("x")).where(F.length("x.value") > 0).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def pending(records: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """Records that an index has not, or has with another content hash."""
    known = index.select(F.col(key), F.col(digest).alias("__known"))
    return records.join(known, key, "left").where(F.col("__known").isNull() | (F.col("__known") != F.col(digest))).drop("__known")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows with the latest version of each key."""
    both = old.unionByName(new)
    return latest_per_key(both, keys, [version], both.columns)


def merged_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Terms by key: greatest relevance, number of sightings, last sighting. Associative, so batches and streams agree."""
    return rows.groupBy(*keys).agg(F.max("relevance").alias("relevance"), F.count(F.lit(1)).alias("evidence_count"), F.max("seen").alias("last_seen"))


def evicted(entries: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """The entries by which a cache exceeds its capacity, first in order; a bounded top-k, so no window over all entries."""
    return entries.orderBy(*order).limit(max(0, entries.count() - capacity))


def cache_key(params: dict[str, Column], version: str) -> Column:
    """Hash of named parameters as JSON with sorted names; the version keeps keys of another schema apart."""
    named = {**params, "version": F.lit(version)}
    return F.md5(F.to_json(F.struct(*[F.coalesce(named[k], F.lit("")).alias(k) for k in sorted(named)])))


ANSWER = "items array<struct<id:string,sector_code:string,confidence:string,title_en:string,summary_en:string>>"


def parsed_responses(asked: DataFrame, answers: DataFrame, batch: str, key: str, answer: str, codes: list[str]) -> DataFrame:
    """(batch, fault, ids): a model's answers checked against what each request asked.

    An answer must be JSON with items; its ids must be those asked, each once; each item
    needs a known code, a known confidence, a title and a summary. The first fault in this
    order is told and the batch has no ids, else they come in the order asked. Requests
    are small by construction, so a batch is one row.
    """
    wanted = asked.groupBy(batch).agg(F.array_sort(F.collect_list(F.col(key))).alias("__asked"))
    read = answers.select(batch, F.from_json(F.col(answer), ANSWER)["items"].alias("__items"))
    rows = wanted.join(read, batch, "left")
    ids = F.transform(F.col("__asked"), lambda k: k.cast("string"))
    given = F.transform(F.col("__items"), lambda i: F.coalesce(i["id"], F.lit("")))

    def blank(c: Column) -> Column:
        return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0

    fault = (
        F.when(F.col("__items").isNull(), "invalid answer")
        .when(F.array_sort(given) != F.array_sort(ids), "other ids")
        .when(F.exists("__items", lambda i: ~F.coalesce(i["sector_code"].isin(codes), F.lit(False))), "invalid code")
        .when(F.exists("__items", lambda i: ~F.coalesce(i["confidence"].isin("high", "medium", "low"), F.lit(False))), "invalid confidence")
        .when(F.exists("__items", lambda i: blank(i["title_en"])), "empty title")
        .when(F.exists("__items", lambda i: blank(i["summary_en"])), "empty summary")
        .otherwise("")
    )
    return rows.withColumn("fault", fault).select(batch, "fault", F.when(F.col("fault") == "", ids).otherwise(F.array().cast("array<string>")).alias("ids"))


def order_verdict(source: DataFrame, enriched: DataFrame, key: str, place: str) -> DataFrame:
    """One row (n_source, n_enriched, n_elsewhere, same): whether two record lists have the same keys in the same order.

    Positions come from ranges of the order, so no task sorts all rows.
    """
    a = distributed_positions(source.select(key, place).withColumn("__one", F.lit(1)), ["__one"], [place, key], "__a").select(key, "__a")
    b = distributed_positions(enriched.select(key, place).withColumn("__one", F.lit(1)), ["__one"], [place, key], "__b").select(key, "__b")
    both = a.join(b, key, "full_outer").agg(F.count("__a").alias("n_source"), F.count("__b").alias("n_enriched"), F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_elsewhere"))
    return both.withColumn("same", (F.col("n_source") == F.col("n_enriched")) & (F.col("n_elsewhere") == 0))
