"""One row per key from tables that repeat keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column], keep: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, as one aggregation.

    ``max_by`` combines map-side, so of a key holding a third of all rows one row a task
    is shuffled (a ``row_number`` window would order the whole group in one task). Derive
    what is needed before and keep only that: texts then never cross the network. Ties are broken by
    the kept values themselves, so repeated rows give one defined result. Null keys form
    one group; nulls order first. Columns not kept are dropped.
    """
    names = [c for c in keep if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[F.col(c) for c in names])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in names]), rank).alias("__kept"))
    return picked.select(*keys, *[F.col("__kept").getField(c).alias(c) for c in names])
