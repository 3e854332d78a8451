"""Several values packed in one field: one row per value, position kept."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters and marks that separate values, apart from white space. Fixed values.
SEPARATORS = r"[;；,，、|｜/\n\r\t]|<\s*/?\s*(?:br|li|p|ul|ol|div)\s*/?\s*>"
#: Marks that open a list line. Fixed values.
LIST_MARK = r"^\s*(?:[-*+•‣▪●·–—]\s+|\(?\d{1,2}[.)]\s+)"
OPEN, CLOSE = "", ""
#: An entry list above this many protected entries is refused rather than compiled.
MAX_ENTRIES = 10_000


def _entry_pattern(entry: str) -> str:
    """Java pattern of one entry; its separators may be escaped, its blanks vary."""
    out = []
    for part in re.findall(r"\s+|\w+|.", entry, re.S):
        if part.isspace():
            out.append(r"\s+")
        elif part.isalnum():
            out.append(part)
        else:
            out.append(r"\\?" + "".join("\\" + c if not c.isalnum() and c != "_" else c for c in part))
    return "".join(out)


def protected_pattern(entries: list[str]) -> str:
    """Pattern of the spans that no separator may split.

    Quoted spans (double, single or typographic quotes that open and close at a
    separator), whole entries of a controlled list, escaped separators, and the
    placeholder characters themselves, so that a placeholder can never collide with text.
    """
    left = r"(?<=^|[;；,，、|｜/\n\r\t\[>]|[;；,，、|｜/\n\r\t\[>•*-]\s{1,8})"
    right = r"(?=\s*(?:$|[;；,，、|｜/\n\r\t\]<]))"
    quoted = [rf'{left}\s*"(?:[^"\\]|\\.|"")*"{right}', rf"{left}\s*'(?:[^'\\]|\\.)*'{right}", rf"{left}\s*“[^”]*”{right}", rf"{left}\s*「[^」]*」{right}"]
    wide = sorted({e.strip() for e in entries if e and re.search(r"[;；,，、|｜/\n\r\t]", e)}, key=lambda e: (-len(e), e))
    listed = [rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(_entry_pattern, wide))})(?![\p{{L}}\p{{N}}])"] if wide else []
    return "|".join([*quoted, *listed, r"\\[;；,，、|｜/\\]", f"[{OPEN}{CLOSE}]"])


def unquoted(span: Column) -> Column:
    """A protected span as its value: quotes off, escapes resolved."""
    body = F.regexp_replace(F.regexp_replace(F.trim(span), r"(?s)^[\"'“「](.*)[\"'”」]$", "$1"), '""', '"')
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def split_packed(df: DataFrame, field: str, entries: list[str] | None = None, blank_separates: bool = False, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value packed in ``field``, with ``pos`` counting non-empty values from 1.

    Quoted spans, entries of a controlled list and escaped separators are replaced by
    indexed placeholders, the rest is split at any separator, the spans are put back by
    array lookup, and the values are exploded with their position. All of it is native
    expressions in one narrow stage: no shuffle, no Python.

    Null, empty and separator-only fields give no rows. Repeated values stay, each with
    its own position. Every other column is kept; a column already named like an output
    column is replaced. ``blank_separates`` also splits at white space (code lists).
    """
    entries = entries or []
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} protected entries")
    pattern = F.lit(protected_pattern(entries))
    rest = [c for c in df.columns if c not in (pos, value)]
    raw = F.regexp_replace(F.col(field), r"^\s*\[(?s)(.*)\]\s*$", "$1")
    separators = SEPARATORS + (r"|\s+" if blank_separates else "")
    staged = df.select(*rest, raw.alias("__raw")).where(F.col("__raw").isNotNull())
    staged = staged.select(*rest, F.regexp_extract_all("__raw", pattern, F.lit(0)).alias("__spans"), F.split("__raw", protected_pattern(entries), -1).alias("__gaps"))
    masked = F.array_join(F.transform("__gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), g))), "")
    staged = staged.select(*rest, F.transform("__spans", unquoted).alias("__spans"), F.split(masked, separators, -1).alias("__parts"))

    def restored(part: Column) -> Column:
        bits = F.split(part, OPEN, -1)
        return F.array_join(
            F.transform(
                bits,
                lambda b, i: F.when(i == 0, b).otherwise(F.concat(F.get(F.col("__spans"), F.substring_index(b, CLOSE, 1).cast("int")), F.substring_index(b, CLOSE, -1))),
            ),
            "",
        )

    tidy = F.transform("__parts", lambda p: F.regexp_replace(restored(F.regexp_replace(p, LIST_MARK, "")), r"^[\s 　]+|[\s 　]+$", ""))
    kept = F.filter(tidy, lambda v: v != "")
    return staged.select(*rest, F.posexplode(kept).alias("__p", value)).select(*rest, (F.col("__p") + 1).alias(pos), value)
