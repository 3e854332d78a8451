"""Windows over time that a hot key cannot overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    """``df`` with the number of rows of the same key in the ``seconds`` up to and at each row, both ends included.

    Time is cut into stretches as long as the window. A row also goes to the next stretch
    as context, so every window lies inside one (key, stretch) and a key that holds a
    third of all rows is spread over its stretches. Rows without time count themselves out
    (null); a null key is a key of its own.
    """
    span = seconds * 1_000_000
    at = F.floor(_micros(ts) / span)
    sent = df.select("*", _micros(ts).alias("__us"), F.explode(F.when(F.col(ts).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(at, at + 1))).alias("__stretch"), at.alias("__own"))
    w = Window.partitionBy(key, "__stretch").orderBy("__us").rangeBetween(-span, 0)
    counted = sent.withColumn(name, F.when(F.col("__us").isNotNull(), F.count(F.lit(1)).over(w)))
    return counted.where(F.col("__stretch").eqNullSafe(F.col("__own"))).drop("__us", "__stretch", "__own")


def carried_forward(df: DataFrame, key: str, ts: str, tie: str, value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` of the same key up to each row in (ts, tie) order.

    Inside a day the value is carried in a window of that day; across days only the last
    value of each (key, day) is carried, one row a day. So the largest task orders one
    day of a key, not the key.
    """
    rows = df.withColumns({"__value": value, "__day": F.to_date(ts)})
    inside = Window.partitionBy(key, "__day").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("__within", F.last("__value", ignorenulls=True).over(inside))
    daily = rows.where(F.col("__value").isNotNull()).groupBy(key, "__day").agg(F.max_by("__value", F.struct(ts, tie)).alias("__close"))
    days = rows.select(key, "__day").distinct().join(daily, [key, "__day"], "left")
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.withColumn("__carry", F.last("__close", ignorenulls=True).over(before)).drop("__close")
    return within.join(carry, [key, "__day"], "left").withColumn(name, F.coalesce("__within", "__carry")).drop("__value", "__day", "__within", "__carry")
