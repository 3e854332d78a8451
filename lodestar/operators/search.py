"""Keyword and hybrid search over the catalogue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalised
from lodestar.functions.vectors import cosine
from lodestar.storage import written

PAGE_SIZE = 20
MIN_SCORE = 0.55
#: Vectors in a block of rows and of queries; a pair of blocks is one task.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 10_000


def scored(df: DataFrame, title: Column, searchable: Column, query: str, related: list[str], vector: Column | None, query_vector: list[float] | None, min_score: float = MIN_SCORE) -> DataFrame:
    """``df`` with ``matches``, ``score`` and ``semantic`` for one query.

    A record matches if its searchable text holds the query, holds a related term, or its
    vector is close enough. A blank query matches everything with score 0. The query and
    its terms are literals, so scoring is one narrow projection.
    """
    q = " ".join(query.lower().split())
    if not q:
        return df.withColumns({"matches": F.lit(True), "score": F.lit(0.0), "semantic": F.lit(0.0)})
    text, head = normalised(searchable), normalised(title)
    exact, in_title = text.contains(q), head.contains(q)
    terms = [" ".join(t.lower().split()) for t in related]
    n_related = sum([text.contains(t).cast("int") for t in terms], F.lit(0))
    near = F.lit(0.0)
    if vector is not None and query_vector:
        near = F.coalesce(cosine(vector, F.array(*[F.lit(float(x)) for x in query_vector])), F.lit(0.0))
    staged = df.withColumns({"__exact": exact, "__title": in_title, "__related": n_related, "semantic": near})
    lexical = F.when(F.col("__exact") | F.col("__title"), 1.0).otherwise(0.0)
    score = F.col("semantic") * 0.60 + lexical * 0.30 + F.least(F.lit(1.0), F.col("__related") / 2.0) * 0.10 + F.when(F.col("__title"), 0.05).otherwise(0.0)
    matches = F.col("__exact") | (F.col("__related") > 0) | (F.col("semantic") >= min_score)
    return staged.withColumns({"matches": matches, "score": score}).drop("__exact", "__title", "__related")


def page_of(df: DataFrame, order: list[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page in order, with the ``total`` before paging.

    The total is one aggregation and the page a bounded top-k; no window over all rows.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))


def distributed_positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based position of each row in its group, without one task per group.

    Rows are range-partitioned by (group, order), so a group holding a third of all rows
    spans many partitions; positions inside a partition are offset by the counts of the
    partitions before it, one row per (group, partition).
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    placed = ranged.withColumn("__at", F.row_number().over(inside) - 1)
    return placed.join(offsets, [*group, "__part"]).withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def interleaved(df: DataFrame, source: str, order: list[str], source_order: DataFrame, ordinal: str) -> DataFrame:
    """``df`` with ``loc`` (position in its source) and ``pos`` (global round-robin position).

    ``pos`` follows from the sizes of the sources alone: of every other source, all rows
    up to the same location come before, and one more where that source comes first. So
    only the per-source totals are combined, and nothing is sorted globally.
    """
    placed = distributed_positions(df, [source], order, "loc")
    totals = placed.groupBy(source).agg(F.count(F.lit(1)).alias("n")).join(source_order, source).select(source, F.col(ordinal).alias("ord"), "n")
    sizes = totals.agg(F.collect_list(F.struct("ord", "n")).alias("sizes"))
    before = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("loc") + F.when(x["ord"] < F.col("ord"), 1).otherwise(0)))
    return placed.join(totals.select(source, "ord"), source).crossJoin(F.broadcast(sizes)).withColumn("pos", before).drop("sizes")


def page_plan(totals: list[tuple[str, int]], page: int, size: int = PAGE_SIZE) -> tuple[int, int, list[tuple[str, int]]]:
    """(pages, page, references) of a round-robin page from the totals of the sources.

    Totals that are no count are 0, a source named twice counts once, the page is clamped.
    """
    counts: dict[str, int] = {}
    for source, n in totals:
        if source not in counts:
            counts[source] = n if isinstance(n, int) and not isinstance(n, bool) and n > 0 else 0
    total = sum(counts.values())
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    first, last = (page - 1) * size, min(page * size, total)
    refs, passed, loc = [], 0, 0
    while passed < last:
        alive = [s for s, n in counts.items() if n > loc]
        rounds = min(counts[s] for s in alive) - loc
        skip = min(rounds, max(0, (first - passed) // len(alive)))
        passed, loc = passed + skip * len(alive), loc + skip
        if skip == rounds:
            continue
        for s in alive:
            if first <= passed < last:
                refs.append((s, loc))
            passed += 1
        loc += 1
    return pages, page, refs


def blocked_similarity(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, vector: str, least: float | None = None, top: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query key, row key, similarity) of a query set against all rows, in blocks.

    Rows and queries are spread over blocks of bounded size by a hash of their key; each
    pair of blocks is one matrix product in one task. ``top`` keeps the best rows of each
    query a block (combined afterwards; the smaller key on ties), ``least`` those at or
    above a similarity. Null vectors have no similarity, nor do vectors of differing
    length. A row that is its own query comes out with itself.
    """
    n_r, n_q = max(1, -(-rows.count() // block_rows)), max(1, -(-queries.count() // block_queries))

    def spread(df: DataFrame, key: str, out: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(key).alias(out), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    held = spread(rows, row_key, "r", "rb", n_r, "qb", n_q)
    sent = spread(queries, query_key, "q", "qb", n_q, "rb", n_r)

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = set(left["v"].map(len)) & set(right["v"].map(len))
        for width in sorted(lengths):
            asked, rows_ = left[left["v"].map(len) == width], right[right["v"].map(len) == width]
            b = np.stack(rows_["v"].to_numpy()).astype(np.float64)
            for a in range(0, len(asked), 256):
                part = asked.iloc[a : a + 256]
                s = np.stack(part["v"].to_numpy()).astype(np.float64) @ b.T
                keep = np.ones(s.shape, bool) if least is None else np.round(s, 6) >= least
                if top is not None and s.shape[1] > top:
                    kth = np.round(np.partition(s, -top, axis=1)[:, -top], 6)
                    keep &= np.round(s, 6) >= kth[:, None]
                i, j = np.nonzero(keep)
                out.append(pd.DataFrame({"q": part["q"].to_numpy()[i], "r": rows_["r"].to_numpy()[j], "similarity": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "r": [], "similarity": []}).astype({"q": "int64", "r": "int64"})

    found = sent.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInPandas(product, "q long, r long, similarity double")
    if top is not None:
        w = Window.partitionBy("q").orderBy(F.round("similarity", 6).desc(), "r")
        found = found.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= top).drop("__rank")
    return found
