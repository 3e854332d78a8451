"""Pruning, joining and counting sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pruned_sources(sources: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, countries: list[str] | None = None, sectors: list[str] | None = None, transfer_types: list[str] | None = None) -> DataFrame:
    """Sources that a request has to ask.

    Listed ones minus excluded ones; of a country, global, or of several countries; able to
    filter by sector if sectors are asked; of a transfer type (a blank one never matches).
    Each condition is a pushed-down predicate on the small source table, which a semi-join
    on ``source_id`` then turns into partition pruning of the catalogue.
    """
    keep: Column = F.lit(True)
    if include:
        keep &= F.col("id").isin(include)
    if exclude:
        keep &= ~F.col("id").isin(exclude)
    if countries:
        keep &= F.coalesce(F.col("country").isin([*countries, "Global"]), F.lit(False)) | F.coalesce("multi_country", F.lit(False))
    if sectors:
        keep &= F.coalesce("sector_filter_supported", F.lit(False))
    if transfer_types:
        keep &= F.coalesce(F.col("transfer_type").isin([t for t in transfer_types if t]), F.lit(False))
    return sources.where(keep)


def totals_by_source(df: DataFrame, source: str) -> DataFrame:
    """(source, total, grand_total): rows of each source and of all together; sources are few, rows are counted map-side."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("total"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("total").alias("grand_total"))))


def with_status(requested: DataFrame, answered: DataFrame, source: str) -> DataFrame:
    """(source, status): ``ok`` for sources that answered, ``failed`` for the others asked."""
    seen = answered.select(source).distinct().withColumn("__ok", F.lit(True))
    return requested.select(F.col("id").alias(source)).join(seen, source, "left").select(source, F.when(F.col("__ok"), "ok").otherwise("failed").alias("status"))
