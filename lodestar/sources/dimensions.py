"""Dimension files with integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.packed import split_packed


def read_code_mapping(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(ntb_code, ntb_label, codes, preferred) of a CSV mapping with packed codes.

    A code that the taxonomy lacks and a preferred code named twice are errors.
    """
    raw = spark.read.schema("ntb_code string, ntb_label string, ics_codes string, preferred_query_for string").option("header", True).option("multiLine", True).csv(path)
    values = split_packed(raw.select("ntb_code", "ics_codes"), "ics_codes", blank_separates=True)
    unknown = [r[0] for r in values.join(known.select(F.col("code").alias("value")), "value", "left_anti").select("value").distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown codes: {unknown}")
    preferred = F.nullif(F.trim("preferred_query_for"), F.lit(""))
    twice = [r[0] for r in raw.where(preferred.isNotNull()).groupBy(preferred.alias("p")).count().where("count > 1").select("p").limit(5).collect()]
    if twice:
        raise ValueError(f"preferred more than once: {twice}")
    codes = values.groupBy("ntb_code").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])).alias("codes"))
    return raw.join(codes, "ntb_code", "left").select("ntb_code", "ntb_label", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), preferred.alias("preferred"))


def read_overrides(spark: SparkSession, path: str, allowed: set[str]) -> DataFrame:
    """(id, sector_code, reason) of reviewed records; blank ids and codes outside the taxonomy are errors."""
    raw = spark.read.schema("id string, sector_code string, reason string").option("header", True).csv(path)
    bad = raw.where((F.length(F.trim(F.coalesce("id", F.lit("")))) == 0) | ~F.coalesce(F.trim("sector_code").isin(*allowed), F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"bad overrides: {[tuple(r) for r in bad]}")
    return raw.select(F.trim("id").alias("id"), F.trim("sector_code").alias("sector_code"), "reason").dropDuplicates(["id"])
