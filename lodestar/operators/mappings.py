"""Provider categories to sectors: ordered rules, bracket groups, paths, terms and lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import clean_space
from lodestar.operators import taxonomy
from lodestar.operators.packed import split_packed
from lodestar.storage import written

NOTHING = "Technology"
# Upper-case words of a patent list's categories and the sector each stands for, first match first. Fixed values.
PATENT_CATEGORIES = [
    ("NEW MATERIAL (ORGANIC", "Materials"), ("NEW MATERIAL (INORGANIC", "Materials"), ("SEMICONDUCTOR", "Electronics"), ("ELECTRONIC DEVICE", "Electronics"), ("MICRO", "Manufacturing"), ("NANOTECHNOLOGY", "Manufacturing"),
    ("MEASUREMENT", "Manufacturing"), ("OPTICS", "Manufacturing"), ("DRUG DISCOVERY", "Health/Medicine"), ("DIAGNOSIS", "Health/Medicine"), ("TREATMENT", "Health/Medicine"), ("MEDICAL", "Health/Medicine"),
    ("BIOTECHNOLOGY", "Agriculture/Biotechnology"), ("CHEMICAL ENGINEERING", "Energy/Environment"), ("SOFTWARE", "IT/Software"), ("ENERGY", "Energy/Environment"), ("GREEN", "Energy/Environment"), ("COMMUNICATION", "IT/Software"), ("MACHINE", "Manufacturing"), ("ROBOT", "Manufacturing"),
]
# Words of two listings' texts and the sector each stands for, first match first. Fixed values.
LISTING_TERMS = [
    ("Agriculture", ["agri", "crop", "farm", "soil", "fertiliz", "seed", "plant", "rice", "fish", "aqua", "food safety", "pesticide", "herb"]), ("Health", ["health", "medic", "pharma", "drug", "diagnos", "therapeut", "disease", "pathogen", "antibacter", "antiviral", "wound", "hospital"]),
    ("Food", ["food", "nutrition", "beverage", "ferment", "postharvest", "cooking", "flour"]), ("Energy", ["energy", "solar", "battery", "fuel", "biomass", "biofuel", "power"]), ("Environment", ["water", "waste", "environ", "recycl", "pollution", "treatment"]),
    ("Materials", ["material", "composite", "coating", "polymer", "textile", "fabric", "nano", "rubber", "adhesive", "paint"]), ("ICT", ["software", "app", "digital", "iot", "sensor", "data", "system", "platform"]), ("Manufacturing", ["manufactur", "machin", "equipment", "tool", "process", "industrial"]),
]
SECTION_TERMS = [
    ("Agriculture", ["agri", "fertiliz", "seed", "crop", "plant", "fungicide", "herbicide", "coconut"]), ("Health", ["wound", "antimicrobial", "antibacterial", "medic", "nutraceutical", "honey", "herbal"]), ("Food", ["food", "nutrition", "wash", "beverage", "packaging"]),
    ("Environment", ["water filtration", "water treat", "waste", "recycl", "oil water", "hydrophobic"]), ("Energy", ["energy", "solar", "battery", "fuel"]),
    ("Materials", ["nano", "graphene", "coating", "composite", "textile", "fabric", "rubber", "polymer", "corrosion", "lubricant", "paint", "glass"]), ("ICT", ["software", "digital", "sensor", "iot", "monitoring"]),
]
# Groups that a profile's applications name in square brackets. Fixed values.
BRACKET_GROUPS = {
    "food, beverages, tobacco": "67", "environmental (clean tech.)": "13", "agriculture": "65", "chemistry, chemical processes": "71", "biological science": "07.080", "building materials, construction technologies, furniture etc.": "91",
    "drugs and pharmaceuticals": "11", "instrumentation, appliances, devices": "17", "electronics": "31", "metallurgy": "77", "energy": "27", "analytical techniques": "19", "medical devices and diagnostics": "11", "leather,textiles and related items": "59",
    "mining and minerals": "73", "computers and electronic data processing": "35", "mechanical": "25", "electrical": "29", "fuels and lubricants": "75", "communications": "33", "aerospace": "49", "transportation": "03", "physics": "07",
}
# Parts of addresses with the category they name and its code, and reviewed last parts. Fixed values.
PATH_CATEGORIES = {"agricultural-productivity": ("Agricultural productivity", "65"), "it-development": ("IT development", "35"), "msme-competitiveness": ("MSME competitiveness", None), "quality-healthcare": ("Quality healthcare", "11"), "disaster-resilience": ("Disaster resilience", None)}
REVIEWED_SLUGS = {
    "nipa-sugar": "67", "nanocoat-glass": "81", "coatin": "87", "clinn-gem": "73", "charm-charging-minutes": "43", "gitara-ni-juan": "97", "microbial-rennet-cheese-making": "67", "chevon-products-slaughtered-goats": "67", "fruitect-biocomposite-coating-fruits": "67",
    "universal-structural-health-evaluation-and-recording-usher": "93", "organomineral": "13", "geo-safer": "35", "remote-sensing-and-data-science-datos": "35", "unmanned-aerial-vehicles": "49",
}
# Categories of a list of links, and words of titles of one of them. Fixed values.
LINK_CATEGORIES = {"Food": "67", "Environment": "13"}
HERBAL = "Herbal"
HERBAL_TERMS = [("67", ["beverage", "drink", "jam", "marmalade", "tea", "leaf powder"]), ("11", ["burn cream", "nutraceutical", "anti-lice", "mouthwash", "toothpaste", "tablet", "pain off", "quality detection kit"])]
HERBAL_REST = "71"
# Categories of a product collection and their codes. Fixed values.
PRODUCT_CATEGORIES = {
    "Agriculture": ["65"], "Renewable Energy": ["27"], "Lifestyle & Fashion": ["61"], "Consulting & Services": ["03"], "E-Commerce": ["35"], "Education": ["03"], "Entertainment": ["97"], "Finance and Banking": ["03"], "Food & Beverages": ["67"], "Gaming": ["35", "97"], "Medical and Healthcare": ["11"],
    "Automotive": ["43"], "Aerospace": ["49"], "Biotechnology": ["07.080"], "Chemicals and Petrochemicals": ["71", "75"], "Real Estate": ["03"], "Tourism and Hospitality": ["03"], "Construction": ["91", "93"], "Information Technology (IT) and Business Process Outsourcing (BPO)": ["35"], "Legal and Law": ["03"],
    "Media and Entertainment": ["33"], "Sports & Recreation": ["97"], "Logistic and Transportation": ["03"], "Jobs & HR": ["03"], "Event Marketing & Advertising": ["03"], "Environmental and Green Technology": ["13"], "Social": ["03"], "Security": ["13"], "Electrical and Electronics": ["29", "31"],
    "Machinery and Equipment": ["25"], "Textiles and Apparel": ["59", "61"], "Oil and Gas": ["75"], "Telecommunications": ["33"],
}
# Markers of a development status in two languages, first match first. Fixed values.
STATUS_MARKERS = [("ถ่ายทอด", "Transfer"), ("transfer", "Transfer"), ("ต้นแบบ", "Prototype"), ("prototype", "Prototype"), ("ทดลอง", "Experimental"), ("experimental", "Experimental"), ("เริ่มต้น", "Initial"), ("initial", "Initial")]


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The value of the first rule of which a term occurs in a text; null text has none."""
    found = F.lit(None).cast("string")
    for value, terms in reversed(rules):
        found = F.when(F.coalesce(text, F.lit("")).rlike("|".join(_literal(t) for t in terms)), value).otherwise(found)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def _literal(term: str) -> str:
    return r"\Q" + term + r"\E"


def patent_sector(categories: Column) -> Column:
    """Sector of a patent's categories: the first known word in their upper-case list."""
    return first_rule(F.upper(F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")), [(v, [k]) for k, v in PATENT_CATEGORIES], NOTHING)


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in table.items() for x in pair]), key)


def bracket_code(applications: Column) -> Column:
    """Code of the first known group in square brackets, over all applications in order; null where none is known."""
    groups = F.flatten(F.transform(F.coalesce(applications, F.array().cast("array<string>")), lambda a: F.regexp_extract_all(F.coalesce(a, F.lit("")), F.lit(r"\[\s*([^\]]+?)\s*\]"), F.lit(1))))
    return F.get(F.array_compact(F.transform(groups, lambda g: _looked_up(BRACKET_GROUPS, F.lower(clean_space(g))))), F.lit(0))


def path_category(url: Column) -> Column:
    """(sector, code, method) of the category in an address; a reviewed last part overrides its code."""
    slug = F.regexp_extract(url, r"([^/]+)/?$", 1)
    sector, code = F.lit(taxonomy.OTHER_LABEL), F.lit(None).cast("string")
    for part, (label, own) in reversed(PATH_CATEGORIES.items()):
        here = F.coalesce(url.contains(f"/technologies/{part}/"), F.lit(False))
        sector, code = F.when(here, label).otherwise(sector), F.when(here, F.lit(own)).otherwise(code)
    reviewed = _looked_up(REVIEWED_SLUGS, F.coalesce(slug, F.lit("")))
    method = F.when(reviewed.isNotNull(), "reviewed_record").when(code.isNotNull(), "category").otherwise("content_fallback")
    return F.struct(sector.alias("sector"), F.coalesce(reviewed, code).alias("code"), method.alias("method"))


def link_category(category: Column, title: Column) -> Column:
    """(code, confidence) of a link by its category, of herbal ones by the words of its title; ``other`` where the category is unknown."""
    herbal = F.coalesce(first_rule(F.lower(F.coalesce(title, F.lit(""))), HERBAL_TERMS), F.lit(HERBAL_REST))
    known = _looked_up(LINK_CATEGORIES, F.coalesce(category, F.lit("")))
    code = F.when(known.isNotNull(), known).when(category == HERBAL, herbal).otherwise(taxonomy.OTHER)
    return F.struct(code.alias("code"), F.when(known.isNotNull(), "high").when(category == HERBAL, "medium").otherwise("low").alias("confidence"))


def product_codes(categories: Column) -> Column:
    """Distinct codes of a product's categories in order, three at most; unknown categories have none."""
    listed = F.array_distinct(F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), clean_space), lambda c: c != ""))
    table = {k: F.array(*[F.lit(c) for c in v]) for k, v in PRODUCT_CATEGORIES.items()}
    return F.slice(F.array_distinct(F.flatten(F.transform(listed, lambda c: F.coalesce(_looked_up(table, c), F.array().cast("array<string>"))))), 1, taxonomy.MOST_CODES)


def development_status(text: Column) -> Column:
    """Status named in a text by marker, else its readiness level, else ''."""
    level = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)TRL[-\s]*(\d)", 1)
    marked = first_rule(F.lower(F.coalesce(text, F.lit(""))), [(v, [k]) for k, v in STATUS_MARKERS])
    return F.coalesce(marked, F.when(level != "", F.concat(F.lit("TRL-"), level)), F.lit(""))


def native_codes(mapping: DataFrame) -> DataFrame:
    """(native_code, native_label, codes, preferred) of a packed code mapping."""
    values = split_packed(mapping.select("ntb_code", "ics_codes"), "ics_codes", blank_separates=True)
    codes = values.groupBy("ntb_code").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])).alias("codes"))
    rows = mapping.groupBy("ntb_code").agg(F.max("ntb_label").alias("native_label"), F.max(F.nullif(F.trim("preferred_query_for"), F.lit(""))).alias("preferred"))
    return rows.join(codes, "ntb_code").select(F.col("ntb_code").alias("native_code"), "native_label", "codes", "preferred")


def native_classified(df: DataFrame, middle_code: str, primary_code: str, middle_name: str, primary_name: str, by_keyword: Column, natives: DataFrame, mapping: DataFrame) -> DataFrame:
    """``df`` with codes, method and confidence by the provider's own codes.

    The middle code is tried before the broader primary one, then the official label of
    the middle and of the primary level, then the category and the keywords as for any
    record. Four equi joins on a small table; the optimiser decides by size whether it is
    broadcast. Blank codes and labels match nothing.
    """

    natives = written(natives, "natives")  # small and asked four times

    def side(key: str, name: str) -> DataFrame:
        kept = natives.where(F.length(F.trim(key)) > 0)
        return kept.groupBy(F.trim(key).alias(name)).agg(F.min("codes").alias(f"{name}_codes"))

    rows = df.withColumns({"__m": F.trim(middle_code), "__p": F.trim(primary_code), "__ml": F.trim(middle_name), "__pl": F.trim(primary_name), "__sector_name": F.coalesce(F.nullif(F.trim(primary_name), F.lit("")), F.trim(middle_name)), "__words": by_keyword})
    for key, name in (("native_code", "__m"), ("native_code", "__p"), ("native_label", "__ml"), ("native_label", "__pl")):
        rows = rows.join(side(key, name), name, "left")
    rows = taxonomy.classified(rows, "__sector_name", F.col("__words"), mapping)
    coded, labelled = F.coalesce("__m_codes", "__p_codes"), F.coalesce("__ml_codes", "__pl_codes")
    by = F.when(coded.isNotNull(), F.lit("native_code")).when(labelled.isNotNull(), F.lit("native_label"))
    return rows.withColumns({"codes": F.coalesce(coded, labelled, "codes"), "method": F.coalesce(by, "method"), "confidence": F.when(by.isNotNull(), "high").otherwise(F.col("confidence"))}).drop("__m", "__p", "__ml", "__pl", "__sector_name", "__words", "__m_codes", "__p_codes", "__ml_codes", "__pl_codes")


def native_query_codes(selected: DataFrame, natives: DataFrame) -> DataFrame:
    """(selected, native_code): the preferred native codes of every selected code and of those below it, each once, by an equi join on all parents."""
    parts = F.split("preferred", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    preferred = natives.where(F.col("preferred").isNotNull()).select("native_code", F.explode(parents).alias("selected"))
    return selected.join(preferred, "selected").select("selected", "native_code").distinct()
