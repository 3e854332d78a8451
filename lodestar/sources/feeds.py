"""Normalising records of XML feeds, patent search hits and node-based REST APIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import clean_space, iso_date, trl_label
from lodestar.schemas import HIT, ITEM, NODE


def _filled(*columns: Column, default: str = "") -> Column:
    """The first column with text."""
    return F.coalesce(*[F.nullif(clean_space(F.coalesce(c, F.lit(""))), F.lit("")) for c in columns], F.lit(default))


def xml_answers(df: DataFrame, xml: str) -> DataFrame:
    """(..., code, message, total, item) of whole answers of an XML feed: a row per item; an answer whose result code is not ``00`` has none, only its code and message."""
    shape = f"header struct<resultCode:string,resultMsg:string>, body struct<items:struct<item:array<struct<{', '.join(p.replace(' ', ':') for p in ITEM.split(', ')).replace(', ', ',')}>>>,totalCount:long>"
    a = df.withColumn("__a", F.from_xml(F.col(xml), shape)).drop(xml)
    code = F.coalesce("__a.header.resultCode", F.lit(""))
    items = F.when(code == "00", F.col("__a.body.items.item"))
    return a.select(*[c for c in df.columns if c != xml], code.alias("code"), F.coalesce("__a.header.resultMsg", F.lit("")).alias("message"), F.coalesce("__a.body.totalCount", F.lit(0)).alias("total"), F.explode_outer(items).alias("item"))


def xml_items(df: DataFrame, xml: str) -> DataFrame:
    """Catalogue fields of the ``<item>`` elements held in a column."""
    i = df.withColumn("__i", F.from_xml(F.col(xml), ITEM)).drop(xml)
    f = {name: F.col(f"__i.{name}") for name in [p.split()[0] for p in ITEM.split(", ")]}

    def listed(c: Column, sign: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sign), lambda v: F.trim(v)), lambda v: v != "")

    return i.select(
        *[c for c in df.columns if c != xml],
        _filled(f["stechNum"]).alias("reference_id"), _filled(f["techName"], default="Untitled").alias("title"), _filled(f["summary"]).alias("summary"),
        _filled(f["tcateNamep"], f["tcateNamem"], default="Uncategorized").alias("sector"), F.concat(listed(f["keyword"], ";"), listed(f["appFld"], ",")).alias("keywords"),
        _filled(f["tcateCodem"]).alias("middle_code"), _filled(f["tcateCodep"]).alias("primary_code"), _filled(f["tcateNamem"]).alias("middle_name"), _filled(f["orgName"]).alias("org_name"),
        _filled(f["transType"]).alias("transfer_type"), _filled(f["devStatusName"]).alias("dev_status"), iso_date(_filled(f["regDate"])).alias("reg_date"),
    )


def patent_hits(df: DataFrame, json: str) -> DataFrame:
    """Catalogue fields of patent search hits held as JSON: first applicant, ISO dates, id by fallback."""
    h = df.withColumn("__h", F.from_json(F.col(json), HIT)).drop(json)
    f = {name: F.col(f"__h.{name}") for name in [p.split()[0] for p in HIT.split(", ")]}
    return h.select(
        *[c for c in df.columns if c != json],
        _filled(f["auApplicationNumber"], f["identifier"]).alias("reference_id"), _filled(f["inventionTitle"], default="Untitled").alias("title"),
        F.trim(F.split_part(_filled(f["applicants"]), F.lit(";"), F.lit(1))).alias("org_name"), _filled(f["patentType"]).alias("patent_type"),
        iso_date(_filled(f["filingDate"])).alias("reg_date"), iso_date(_filled(f["earliestPriorityDate"])).alias("priority_date"), _filled(f["applicationStatus"]).alias("dev_status"),
    )


def nodes(df: DataFrame, json: str, country_names: DataFrame, base_url: str, sector_names: DataFrame | None = None) -> DataFrame:
    """Catalogue fields of published nodes held as JSON.

    Nodes without id or title and unpublished ones are dropped. References to countries
    are resolved by an equi join per reference, in order, each name once; unknown ones are
    skipped. ``search_summary`` joins all text fields, ``summary`` is the first of four.
    ``sector_names`` (tid, name, code) resolves the references to sectors in the same way
    into ``sectors`` and their distinct ``sector_codes``.
    """
    n = df.withColumn("__n", F.from_json(F.col(json), NODE))

    def first(name: str) -> Column:
        return clean_space(F.coalesce(F.get(F.col(f"__n.{name}.value"), F.lit(0)), F.lit("")))

    kept = n.where((first("nid") != "") & (first("title") != "") & F.lower(first("status")).isin("1", "true"))
    fields = [first(x) for x in ("description", "body", "benefits", "applications", "cooperation")]
    summary = F.coalesce(*[F.nullif(x, F.lit("")) for x in fields[:4]], F.lit(""))
    alias = F.coalesce(F.get(F.col("__n.path.alias"), F.lit(0)), F.lit(""))
    flat = kept.select(
        F.concat(F.lit("node_"), first("nid")).alias("id"), first("title").alias("title"), summary.alias("summary"),
        F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (summary, *fields[1:])]).alias("search_summary"),
        F.filter(F.transform(F.coalesce(F.col("__n.keywords.value"), F.array().cast("array<string>")), clean_space), lambda v: v != "").alias("keywords"),
        first("organization").alias("org_name"), F.coalesce(F.nullif(first("langcode"), F.lit("")), F.lit("en")).alias("language"), F.left(first("created"), F.lit(10)).alias("reg_date"),
        trl_label(first("readiness")).alias("dev_status"), F.when(F.startswith(alias, F.lit("/")), F.concat(F.lit(base_url), alias)).otherwise(F.concat(F.lit(base_url + "/node/"), first("nid"))).alias("url"),
        F.col("__n.countries.target_id").alias("__refs"), F.col("__n.sectors.target_id").alias("__own"),
    )

    def resolved(column: str, names: DataFrame, *fields: str) -> DataFrame:
        refs = flat.select("id", F.posexplode(column).alias("pos", "ref")).select("id", "pos", F.expr("try_cast(ref AS INT)").alias("tid"))
        listed = F.array_sort(F.collect_list(F.struct("pos", *fields)))

        def only(f: str) -> Column:
            return F.array_distinct(F.transform(listed, lambda x: x[f])).alias(f"{f}s")

        return refs.join(names.select("tid", *fields), "tid").groupBy("id").agg(*[only(f) for f in fields])

    found = flat.join(resolved("__refs", country_names, "name").withColumnRenamed("names", "countries"), "id", "left").withColumn("countries", F.coalesce("countries", F.array(F.lit("Unspecified"))))
    if sector_names is not None:
        none = F.array().cast("array<string>")
        found = found.join(resolved("__own", sector_names, "name", "code").withColumnRenamed("names", "sectors").withColumnRenamed("codes", "sector_codes"), "id", "left")
        found = found.withColumns({"sectors": F.coalesce("sectors", none), "sector_codes": F.coalesce("sector_codes", none)})
    return found.drop("__refs", "__own")


def patent_projection(df: DataFrame, number: str, document_base: str, list_url: str) -> DataFrame:
    """``df`` with url, reference_id and record_type of a patent list: a number of digits only is a granted patent with a document of its own, anything else an application found on the list."""
    reference = F.trim(F.coalesce(F.col(number), F.lit("")))
    granted = reference.rlike(r"^[0-9]+$")
    return df.withColumns({"url": F.when(granted, F.concat(F.lit(f"{document_base}/US"), reference, F.lit("B2.pdf"))).otherwise(list_url), "reference_id": reference, "record_type": F.when(granted, "US Patent").otherwise("US Patent Application")})


def patent_links(df: DataFrame, number: str, title: str, document_base: str, search_base: str) -> DataFrame:
    """``df`` with destination, reference_label, reference_shown and subject: where a patent's card leads and how an inquiry about it begins."""
    reference = F.trim(F.coalesce(F.col(number), F.lit("")))
    granted = reference.rlike(r"^[0-9]+$")
    quoted = F.concat(F.lit('"'), reference, F.lit('" "'), F.coalesce(F.col(title), F.lit("")), F.lit('"'))
    named = F.when(reference == "", F.coalesce(F.col(title), F.lit(""))).otherwise(F.concat(F.when(granted, "US Patent ").otherwise("US Patent Application "), reference))
    return df.withColumns({
        "destination": F.when(granted, F.concat(F.lit(f"{document_base}/US"), reference, F.lit("B2.pdf"))).otherwise(F.concat(F.lit(search_base), F.replace(F.url_encode(quoted), F.lit("+"), F.lit("%20")))),
        "reference_label": F.when(granted, "US patent number").otherwise("US application number"), "reference_shown": F.when(reference == "", "See the listing").when(granted, F.concat(F.lit("US "), reference)).otherwise(reference), "subject": F.concat(F.lit("Licensing inquiry – "), named),
    })
