"""Mixing sources to target weights in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.storage import written

#: Where the public tokenizer's vocabulary lies; every executor must see the path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pre-splitting pattern of that tokenizer family. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens in a block, the unit of apportionment at every size; about one document.
BLOCK = 128
#: A source has a shard for every so many of its documents; one task orders a shard.
SHARD_ROWS = 50_000
SEED = 20250101
_ENCODINGS: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(df: DataFrame, columns: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``columns`` and ``tokens``: the number of tokens of every whole text (0 for null)."""
    fields = [df.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(counts, pa.int64())], [*columns, "tokens"])

    return df.select(*columns, text).mapInArrow(run, T.StructType([*fields, T.StructField("tokens", T.LongType())]))


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), never above a cap; ties go to the earlier party.

    All quotients above a bound are seated at once and only the last seats one by one, so
    the work does not grow with the number of seats.
    """

    def above(bound: float) -> list[int]:
        return [min(c, int((w / bound + 1) / 2)) if w > 0 else 0 for w, c in zip(weights, caps)]

    if seats <= 0 or not any(w > 0 and c > 0 for w, c in zip(weights, caps)):
        return [0] * len(weights)
    low, high = 0.0, 2 * max(weights) + 1
    for _ in range(200):
        middle = (low + high) / 2
        if middle > 0 and sum(above(middle)) <= seats:
            high = middle
        else:
            low = middle
    got = above(high)
    if sum(got) > seats:  # cannot be at the first bound; kept for weights near the limits of floats
        got = [0] * len(weights)
    left = seats - sum(got)
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


@dataclass
class Mixture:
    """What a mixture consists of: the selected documents and the report per source."""

    selection: DataFrame
    shares: DataFrame


def mix_sources(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> Mixture:
    """Select documents so that each source makes up its target share of all tokens.

    The mixture is as large as the scarcest source allows when each document may occur up
    to its source's ``max_repeats`` times. Every source is cut into shards by a seeded
    hash of the key, each shard into blocks of equal tokens in seeded order. Sainte-Lague
    gives each source an integer number of blocks by its target share and each of its
    shards a number by the tokens it holds; a shard takes its leading blocks, going round
    again for further copies. A document belongs to the block its first token falls in.

    Only one row per (source, shard) reaches the driver; a source has a shard for every
    ``SHARD_ROWS`` of its documents, so no task orders an unbounded group. Documents of
    sources without target, without source or without tokens are left out; repeated rows
    of a key count as one document. ``selection`` has (doc key, source, tokens, copies),
    ``shares`` the target and actual share, tokens and highest number of copies.
    """
    goal = [(r[0], float(r[1]), int(r[2] or 1)) for r in targets.select("source", "target_share", "max_repeats").where(F.col("target_share") > 0).collect()]
    rows = df.where(F.col(source).isin([g[0] for g in goal])).select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    counted = token_counts(rows, ["k", "s"], "t", path).groupBy("k", "s").agg(F.max("tokens").alias("tokens")).where(F.col("tokens") > 0)
    n_rows = {r[0]: r[1] for r in rows.groupBy("s").count().collect()}
    n_shards = F.lit(1)
    for s, n in n_rows.items():
        if n > SHARD_ROWS:
            n_shards = F.when(F.col("s") == s, -(-n // SHARD_ROWS)).otherwise(n_shards)
    draw = F.xxhash64(F.lit(seed), "k", "s")
    counted = written(counted.select("k", "s", "tokens", draw.alias("draw"), F.pmod(F.xxhash64(draw, F.lit("shard")), n_shards).cast("int").alias("shard")), "tokens")
    held = {(r[0], r[1]): r[2] for r in counted.groupBy("s", "shard").agg(F.sum("tokens")).collect()}
    size = {g[0]: sum(v for (s, _), v in held.items() if s == g[0]) for g in goal}
    present = [g for g in goal if size[g[0]]]
    whole = sum(g[1] for g in present)
    total = min((size[s] * most / (share / whole) for s, share, most in present), default=0)
    quotas = sainte_lague([g[1] for g in present], [int(size[s] * most // BLOCK) for s, _, most in present], int(total // BLOCK))
    plan = []
    for (s, _, most), q in zip(present, quotas):
        shards = sorted((sh, v) for (x, sh), v in held.items() if x == s)
        given = sainte_lague([float(v) for _, v in shards], [int(v * most // BLOCK) for _, v in shards], q)
        plan += [(s, sh, int(g), int(v)) for (sh, v), g in zip(shards, given)]
    spark = df.sparkSession
    quota = F.broadcast(spark.createDataFrame(plan, "s string, shard int, blocks long, held long"))

    order = Window.partitionBy("s", "shard").orderBy("draw", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    want = F.col("blocks") * F.lit(BLOCK)
    copies = F.floor(want / F.col("held")) + F.when(F.col("before") + F.col("tokens") / 2 < want % F.col("held"), 1).otherwise(0)
    chosen = placed.join(quota, ["s", "shard"]).select(F.col("k").alias(key), F.col("s").alias(source), "tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0)
    wanted = spark.createDataFrame([(s, share, most) for s, share, most in goal], "source string, target_share double, max_repeats int")
    per = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    report = F.broadcast(wanted).join(per, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    all_tokens = report.agg(F.sum("tokens").alias("all"))
    shares = report.crossJoin(F.broadcast(all_tokens)).select("source", "target_share", F.round(F.col("tokens") / F.col("all"), 6).alias("actual_share"), "tokens", "n_docs", "max_repeats", "most_copies")
    return Mixture(chosen, shares)
