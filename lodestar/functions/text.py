"""Text functions of the catalogue as column expressions."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that must not be learnt: links, addresses, numbers that look like telephone numbers. Fixed value.
SENSITIVE = r"(?i)(https?://|www\.|@|(\+?\d[\d ().-]{7,}\d))"
#: Longest document text for an embedding. Fixed value.
DOCUMENT_CHARS = 6000
# Words that are no keywords. Fixed values.
STOP_WORDS = ("and", "for", "from", "with", "using", "that", "this", "the", "its", "use")


def clean_space(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised(c: Column) -> Column:
    """Search form of a text: lower case, white space collapsed; null as ''. JVM-side; equals ``normalised_exact`` on composed text."""
    return clean_space(F.lower(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.StringType())
def normalised_exact(values: pd.Series) -> pd.Series:
    """Search form with compatibility composition, for texts with full-width or ligature characters."""
    return values.map(lambda v: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v or "").strip().lower()))


def searchable_text(title: Column, summary: Column, institute: Column, keywords: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(institute, F.lit("")), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " ")))


def document_text(title: Column, summary: Column, institute: Column, keywords: Column) -> Column:
    """Labelled text of a record for an embedding, cut at ``DOCUMENT_CHARS``."""

    def part(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    joined = F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), ", ")
    return F.substring(F.concat(F.lit("Title: "), part(title), F.lit("\nSummary: "), part(summary), F.lit("\nKeywords: "), joined, F.lit("\nInstitution: "), part(institute)), 1, DOCUMENT_CHARS)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))


def slug(c: Column, most: int = 50) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(most))


def keywords_of(c: Column, longer_than: int = 3, most: int = 10) -> Column:
    """First distinct words of a text, longer than so many letters and no stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > longer_than) & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, most)


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


# Sequences of a wrong decoding and what they stand for, for display. Fixed values.
DISPLAY_REPAIRS = [("â€“", "–"), ("â€”", "—"), ("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€", "”"), ("â€¦", "…"), ("Â°C", "°C"), ("Â ", " ")]


def display_text(c: Column) -> Column:
    for wrong, right in DISPLAY_REPAIRS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


#: Phrases by which a translation service reports an error in place of a translation. Fixed values.
TRANSLATION_ERRORS = ("MYMEMORY WARNING", "YOU USED ALL AVAILABLE FREE TRANSLATIONS", "NEXT AVAILABLE IN", "QUERY LENGTH LIMIT EXCEEDED", "INVALID EMAIL")


def translation_status(original: Column, translated: Column, status: Column, details: Column) -> Column:
    """What came of a translation: an error, a used-up quota, the original kept, or a translation."""

    def told(c: Column) -> Column:
        return F.greatest(F.lit(False), *[F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit(m)) for m in TRANSLATION_ERRORS])

    text = F.trim(F.coalesce(translated, F.lit("")))
    return F.when(status.isNotNull() & (status != 200), F.when(status == 429, "quota_exceeded").otherwise("api_error")).when(told(text) | told(details), "quota_exceeded").when((text == "") | (F.lower(text) == F.lower(F.trim(original))), "original_preserved").otherwise("translated")


def is_sensitive(c: Column) -> Column:
    return c.rlike(SENSITIVE)


def is_safe_term(term: Column, query: Column) -> Column:
    """Whether a normalised term may be kept: not the query, 2 to 80 characters, 8 words at most, not sensitive."""
    return (term != "") & (term != query) & F.length(term).between(2, 80) & (F.size(F.split(term, " ")) <= 8) & ~is_sensitive(term)


def is_valid_url(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^https?://[^/?#\s]+")


def is_thai(c: Column) -> Column:
    return c.rlike("[\\u0E00-\\u0E7F]")


def length_bucket(n: Column) -> Column:
    """Bucket of a query length that may be reported in place of the query."""
    return F.when(n <= 0, "0").when(n <= 20, "1-20").when(n <= 50, "21-50").when(n <= 100, "51-100").when(n <= 200, "101-200").otherwise("200+")


def trl_label(c: Column) -> Column:
    """``trl_8_system_complete`` as ``TRL 8 — System complete``; anything else with blanks and capitals."""
    rest = F.trim(F.replace(F.regexp_extract(c, r"^trl_(\d+)_(.+)$", 2), F.lit("_"), F.lit(" ")))
    capital = F.concat(F.upper(F.left(rest, F.lit(1))), F.lower(F.substring(rest, 2, 1000)))
    return F.when(c.rlike(r"^trl_\d+_.+$"), F.concat(F.lit("TRL "), F.regexp_extract(c, r"^trl_(\d+)_(.+)$", 1), F.lit(" — "), capital)).otherwise(F.initcap(F.trim(F.replace(c, F.lit("_"), F.lit(" ")))))


def iso_date(c: Column) -> Column:
    """Eight digits as an ISO date; other notations pass."""
    return F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise(c)


def initials(c: Column) -> Column:
    """First letters of the first two words longer than three letters."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.length(w) > 3)
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def csv_values(c: Column) -> Column:
    """Values of a comma list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


@F.pandas_udf(T.StringType())
def client_address(forwarded: pd.Series, peer: pd.Series) -> pd.Series:
    """Right-most forwarded address if it is one, else the peer, else ``unknown``."""

    def valid(v: str | None) -> str | None:
        try:
            return str(ipaddress.ip_address((v or "").strip()))
        except ValueError:
            return None

    return pd.Series([valid((f or "").split(",")[-1]) or valid(p) or "unknown" for f, p in zip(forwarded, peer)])


@F.pandas_udf(T.StringType())
def repaired_encoding(values: pd.Series) -> pd.Series:
    """UTF-8 text that was read as Mac Roman, put right; at most two rounds, other text as it is."""

    def once(run: re.Match) -> str:
        try:
            return run.group().encode("mac_roman").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return run.group()

    def fixed(v: str | None) -> str | None:
        if v is None or v.isascii():
            return v
        for _ in range(2):
            w = re.sub(r"[^\x00-\x7f]+", once, v)
            if w == v:
                break
            v = w
        return v

    return values.map(fixed)
