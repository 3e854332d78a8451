"""The catalogue and its shared SQL, which the other query modules build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import searchable_text
from lodestar.operators.records import latest_per_key
from lodestar.storage import table


def catalogue(spark: SparkSession, d: str, columns: list[str], **derived: Column) -> DataFrame:
    """The latest row of every record id; only the named columns are read and shuffled.

    ``derived`` columns are computed from whole rows before rows of one id are combined,
    so a text that only serves a flag, a code or a hash is not shuffled.
    """
    rows = table(spark, d, "technology").withColumns(derived) if derived else table(spark, d, "technology")
    return latest_per_key(rows, ["id"], ["fetched_at"], ["id", *columns, *derived])


SEARCHED = ["title", "summary", "org_name", "keywords"]


def searchable() -> Column:
    return searchable_text(*[F.col(c) for c in SEARCHED])


CAT = "cat AS (SELECT * FROM technology QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) = 1)"
NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\s\x{{A0}}\x{{3000}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}]+', ' ', 'g'))"
SEARCHABLE = "trim(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(org_name, '') || ' ' || coalesce(array_to_string(keywords, ' '), ''))"


def norm(x: str) -> str:
    return NORM.format(x)
