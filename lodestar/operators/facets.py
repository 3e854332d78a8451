"""Query-aware facet counts in which no facet filters itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.taxonomy import OTHER, matches_sectors


def facet_counts(df: DataFrame, key: Column, query: Column, source: Column, countries: Column, codes: Column, parents: Column, sources: list[str], countries_selected: list[str], sectors: list[str]) -> DataFrame:
    """(facet, value, n): counts of the source, country and sector facets in one pass.

    The query applies to all facets; each facet applies the selections of the other two.
    A record counts once for its source, once for each of its countries and once for each
    distinct parent sector (``other`` if it has none). Every record is exploded into a
    tagged array of its facet values, so the multi-valued facets cannot inflate the
    others, and one aggregation with map-side combine counts them all.
    """
    in_source = source.isin(sources) if sources else F.lit(True)
    in_country = F.arrays_overlap(countries, F.array(*[F.lit(c) for c in countries_selected])) if countries_selected else F.lit(True)
    in_sector = matches_sectors(codes, sectors)
    none = F.array().cast("array<struct<facet:string,value:string>>")

    def tagged(name: str, values: Column, on: Column) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))).otherwise(none)

    values = F.concat(
        tagged("source", F.array(source), in_country & in_sector),
        tagged("country", F.array_distinct(countries), in_source & in_sector),
        tagged("sector", F.when(F.size(parents) > 0, parents).otherwise(F.array(F.lit(OTHER))), in_source & in_country),
    )
    hit = df.where(query).select(F.explode(values).alias("x"))
    return hit.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def filled_facets(counts: DataFrame, domain: DataFrame) -> DataFrame:
    """Counts over a whole domain (value, available): 0 where none, null where the count is unknown."""
    return domain.join(counts.select("value", "n"), "value", "left").select("value", F.when(F.col("available"), F.coalesce("n", F.lit(0))).alias("n"))
