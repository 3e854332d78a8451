import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestar.operators.timelines import carried_forward, trailing_count

T0 = datetime(2024, 1, 1)


def rows(n=400):
    rng = random.Random(4)
    return [(i, T0 + timedelta(seconds=rng.choice([rng.randrange(300_000), 60 * rng.randrange(40)])), rng.choice([1, 1, 1, 2, None])) for i in range(n)]


def test_trailing_count_against_brute_force(spark):
    data = [*rows(), (998, None, 1), (999, None, 1)]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, k long").withColumn("extra", F.lit(1))
    got = {r["id"]: r["n"] for r in trailing_count(df, "k", "ts", 3600, "n").collect()}
    assert got == {i: None if t is None else sum(1 for _, u, q in data if q == k and u is not None and t - timedelta(hours=1) <= u <= t) for i, t, k in data}


def test_carried_forward_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, k long")
    got = {r["id"]: r["last"] for r in carried_forward(df.where("k is not null"), "k", "ts", "id", F.when(F.col("id") % 7 == 0, F.col("id")), "last").collect()}
    want = {}
    for k in (1, 2):
        seen = None
        for i, t, _ in sorted((r for r in data if r[2] == k), key=lambda r: (r[1], r[0])):
            seen = i if i % 7 == 0 else seen
            want[i] = seen
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, ts timestamp_ntz, k long")
    assert trailing_count(df, "k", "ts", 60, "n").count() == 0 and carried_forward(df, "k", "ts", "id", F.col("id"), "x").count() == 0
