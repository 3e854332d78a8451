"""Classification of records against the shared sector taxonomy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, OTHER_LABEL = "other", "Other / Unclassified"
SCHEME, VERSION = "ISO ICS", "7"
# Top-level fields of the International Classification for Standards. Fixed values.
TOP_LEVEL = {
    "01": "Generalities. Terminology. Standardization. Documentation",
    "03": "Services. Company organization, management and quality. Administration. Transport. Sociology",
    "07": "Natural and applied sciences", "11": "Health care technology", "13": "Environment. Health protection. Safety", "17": "Metrology and measurement. Physical phenomena",
    "19": "Testing", "21": "Mechanical systems and components for general use", "23": "Fluid systems and components for general use", "25": "Manufacturing engineering",
    "27": "Energy and heat transfer engineering", "29": "Electrical engineering", "31": "Electronics", "33": "Telecommunications. Audio and video engineering", "35": "Information technology",
    "37": "Image technology", "39": "Precision mechanics. Jewellery", "43": "Road vehicles engineering", "45": "Railway engineering", "47": "Shipbuilding and marine structures",
    "49": "Aircraft and space vehicle engineering", "53": "Materials handling equipment", "55": "Packaging and distribution of goods", "59": "Textile and leather technology", "61": "Clothing industry",
    "65": "Agriculture", "67": "Food technology", "71": "Chemical technology", "73": "Mining and minerals", "75": "Petroleum and related technologies", "77": "Metallurgy", "79": "Wood technology",
    "81": "Glass and ceramics industries", "83": "Rubber and plastic industries", "85": "Paper technology", "87": "Paint and colour industries", "91": "Construction materials and building",
    "93": "Civil engineering", "95": "Military affairs. Military engineering. Weapons", "97": "Domestic and commercial equipment. Entertainment. Sports",
}
# Codes below the top level. Fixed values.
DETAIL = {"07.080": "Biotechnology"}
LABELS = TOP_LEVEL | DETAIL
# Ordered keyword rules: the first three fields whose terms occur. Fixed values.
KEYWORD_RULES = [
    ("07.080", ["biotech", "genome", "genetic", "cell culture", "enzyme", "microorganism"]),
    ("11", ["medical", "health", "diagnos", "therap", "hospital", "pharma", "drug", "vaccine"]),
    ("13", ["environment", "pollution", "wastewater", "waste water", "recycl", "emission", "sanitation"]),
    ("27", ["solar", "renewable", "biofuel", "biomass", "battery", "energy", "heat pump", "hydrogen"]),
    ("29", ["electrical", "electric power", "transformer", "inverter", "power grid"]),
    ("31", ["semiconductor", "electronic", "circuit", "sensor", "photonic"]),
    ("35", ["software", "artificial intelligence", "machine learning", "digital", "database", "iot", "cyber"]),
    ("43", ["automotive", "road vehicle", "electric vehicle"]),
    ("45", ["railway", "rail transport"]),
    ("47", ["shipbuilding", "marine structure", "vessel"]),
    ("49", ["aircraft", "aerospace", "space vehicle", "satellite"]),
    ("65", ["agriculture", "agricultural", "crop", "farm", "fertiliz", "irrigation", "aquaculture", "fishery", "fisher"]),
    ("67", ["food", "beverage", "nutrition", "postharvest", "ferment"]),
    ("71", ["chemical", "catalyst", "solvent", "coating", "cosmetic", "essential oil"]),
    ("77", ["metallurgy", "metal", "alloy", "steel", "aluminium", "aluminum"]),
    ("81", ["ceramic", "glass"]),
    ("83", ["polymer", "plastic", "rubber", "elastomer"]),
    ("59", ["textile", "fabric", "fibre", "fiber", "coir", "sericulture"]),
    ("91", ["building material", "construction material", "cement", "concrete"]),
    ("93", ["civil engineering", "bridge", "road construction"]),
    ("95", ["defence", "defense", "weapon", "military"]),
    ("25", ["manufactur", "machin", "industrial process", "robot", "automation", "equipment"]),
]
MOST_CODES = 3


def keyword_codes(text: Column) -> Column:
    """Codes of the first rules whose terms occur in a text, in rule order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.rlike("|".join(terms)), F.lit(code)) for code, terms in KEYWORD_RULES]
    return F.slice(F.array_compact(F.array(*hits)), 1, MOST_CODES)


def known_codes(codes: Column) -> Column:
    """Distinct codes of the taxonomy, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c.isin(*LABELS)))


def labels_of(codes: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.transform(codes, lambda c: F.try_element_at(table, c))


def top_level(codes: Column) -> Column:
    """Distinct parents of codes that the taxonomy knows, in order."""
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.split_part(c, F.lit("."), F.lit(1))), lambda c: c.isin(*TOP_LEVEL)))


def matches_sectors(codes: Column, selected: list[str]) -> Column:
    """Whether a record falls in a selection: a code equal to or below a selected one, or none at all for ``other``."""
    if not selected:
        return F.lit(True)
    own = F.coalesce(codes, F.array().cast("array<string>"))
    hit = F.exists(own, lambda c: c.isin(*selected) | F.greatest(F.lit(False), *[c.startswith(s + ".") for s in selected]))
    return hit | (F.size(own) == 0) if OTHER in selected else hit


def classified(df: DataFrame, source_sector: str, by_keyword: Column, mapping: DataFrame) -> DataFrame:
    """``df`` with codes, method and confidence: the provider's category where it maps, else the codes of keyword rules.

    ``by_keyword`` is ``keyword_codes`` of the record's text. ``mapping`` has (source_sector, ics_codes). The join is an equi join on the normalised
    category; whether it is broadcast is left to its measured size.
    """
    keyed = mapping.groupBy(F.lower(F.trim(F.regexp_replace("source_sector", r"\s+", " "))).alias("__sector")).agg(F.max("ics_codes").alias("__mapped"))
    sector = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(source_sector), F.lit("")), r"\s+", " ")))
    joined = df.withColumns({"__sector": sector, "__found": by_keyword}).join(keyed, "__sector", "left")
    exact = F.size(F.coalesce("__mapped", F.array().cast("array<string>"))) > 0
    by_words = F.size("__found") > 0
    codes = F.when(exact, F.col("__mapped")).otherwise(F.col("__found"))
    general = F.col("__sector") == "materials"
    method = F.when(exact, "source_mapping").when(by_words, F.when(general, "keyword_mapping").otherwise("keyword_fallback")).otherwise("unclassified")
    confidence = F.when(exact, "high").when(by_words & general, "medium").otherwise("low")
    return joined.withColumns({"codes": codes, "method": method, "confidence": confidence}).drop("__sector", "__found", "__mapped")


def explicit_first(codes: Column, code: Column, method: Column, confidence: Column, fallback: Column) -> Column:
    """Classification struct by precedence: listed codes, one top-level code, ``other``, else the fallback codes."""
    listed = known_codes(codes)
    one = F.trim(F.coalesce(code, F.lit("")))
    sure = F.when(F.coalesce(confidence, F.lit("high")).isin("high", "medium", "low"), F.coalesce(confidence, F.lit("high"))).otherwise("low")
    none = F.array().cast("array<string>")

    def result(c: Column, m: Column | str, s: Column | str) -> Column:
        return F.struct(c.alias("codes"), (F.lit(m) if isinstance(m, str) else m).alias("method"), (F.lit(s) if isinstance(s, str) else s).alias("confidence"))

    return (
        F.when(F.size(listed) > 0, result(listed, F.coalesce(method, F.lit("indexed_sector_codes")), sure))
        .when(one.isin(*TOP_LEVEL), result(F.array(one), F.coalesce(method, F.lit("indexed_sector_code")), sure))
        .when(one == OTHER, result(none, F.coalesce(method, F.lit("indexed_unclassified")), "low"))
        .otherwise(result(fallback, F.when(F.size(fallback) > 0, "keyword_fallback").otherwise("unclassified"), "low"))
    )
