"""Text values that were cut before their end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.residue import SLOT, SLOT_SIGN, is_message
from lodestar.storage import written

#: Marks that a source or a transfer leaves where it cuts. Fixed values.
CUT_MARK = re.compile(r"(?:\[\s*(?:\.{2,}|…)\s*\]|\[\s*(?:more|cont(?:inued|\.)?|read more|truncated)\s*\]|\((?:continued|more|truncated|cont\.?)\)|(?:\.{3}|…)?\s*(?:read|view|see|show)\s+(?:full(?:\s+\w+)?|more)|>>|»)\s*$|&#?\w{0,6}$|<[a-z/]?[a-z]{0,5}$|�+\s*$", re.I)
DOTS = re.compile(r"\s*(?:…|\.{2,})\s*$")
#: Text that ends a statement. Fixed values.
TERMINAL = re.compile(r"[.!?。！？।｡؟‼⁈]['\"”’」』）)\]»]*\s*$")
_SPACELESS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_TOKEN = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|(?:[^\W฀-๿぀-ヿ㐀-鿿]|[̀-ͯऀ-ःऺ-ॏ])+|…|\.{2,}|[.!?。！？।]+(?=\s|$|[\"”’」』）)])|(?<=[。！？।])|(?<=[ก-๛])[ \n]+(?=[ก-๛])")
#: Tail lengths in words, and in characters where words are not spaced, longest first.
TAILS, CHAR_TAILS = (6, 4, 3), (24, 14, 8)
#: A length is a spike if at least so many values have it, and so many times as many as lengths near it.
SPIKE, OVER = 4, 6.0
#: A tail ends a text if at least this share of its other uses end a statement; at a spike of lengths it takes more.
ENDS, SURELY_ENDS = 0.5, 0.9
#: A longest tail that so many different texts end with, and none goes on after, is a fixed ending and no cut ...
USUAL = 3
#: ... if this share of the texts that hold it up to its last unit end so; a cut inside a common phrase is rare there.
FIXED = 0.5
#: Lengths of what stands before the last unit of a longest tail.
_BEFORE = (TAILS[0] - 1, CHAR_TAILS[0] - 1)
#: Longest tail, in units, of either kind.
_REACH = max(TAILS + CHAR_TAILS)
#: Bits of the filter that tells asked tails apart while texts are scanned; fixed in size, and only a filter: an exact join follows.
FILTER_BITS = 1 << 23
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_AFTER_SLOT = re.compile(rf"(?:\s*(?:{SLOT}|</?(?:p|div|span)\b[^<>]*>))+\s*$")
_SIGN = re.compile(SLOT_SIGN)
_MAY_CLOSE = re.compile(r"[}\])>%_*@!a-zA-Z]\s*$")


#: Ids of the end of a statement and of an ellipsis; other units have the hash of what they stand for, the sign bit telling unspaced script.
_STOP, _DOTS = 1, 2
_UNSPACED = 1 << 63


class _Ids(dict):
    """Ids of units: of a word in lower case (a character where words are not spaced), of any number, of what ends a statement."""

    def __missing__(self, u: str) -> int:
        if u[:1] == "…" or u[:2] == "..":
            i = _DOTS
        elif not u or u[0] in ".!?。！？।" or u.isspace():
            i = _STOP
        else:
            i = xxhash.xxh3_64_intdigest("9" if u[0].isdigit() else u) & ~_UNSPACED | 4 | (_UNSPACED if _SPACELESS.match(u) else 0)
        if len(self) > 500_000:
            self.clear()
        self[u] = i
        return i


def _units(text: str, ids: _Ids) -> list[int]:
    return [ids[u] for u in _TOKEN.findall(text.lower())]


class _Tails:
    """Keys of the unit runs that end at every position of many texts, as vectors."""

    def __init__(self, texts: list[list[int]]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.ends = np.cumsum(self.sizes)
        self.depth = np.arange(len(self.owner)) - (self.ends - self.sizes)[self.owner] + 1
        self.ids = np.fromiter((i for units in texts for i in units), np.uint64, len(self.owner))
        self.spaceless = self.ids >= np.uint64(_UNSPACED)
        with np.errstate(over="ignore"):
            power = np.full(len(self.ids) + 1, _STEP)
            power[0] = 1
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.ids * np.cumprod(power)[1:], dtype=np.uint64)])
            power[1:] = _INVERSE
            self.back = np.cumprod(power)[1:]

    def keys(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of the tail of this rank (3: what stands before a longest tail's last unit) at every position, and whether the text is long enough there."""
        words, chars = (TAILS[rank], CHAR_TAILS[rank]) if rank < 3 else _BEFORE
        n = np.where(self.spaceless, chars, words)
        at = np.arange(len(n))
        with np.errstate(over="ignore"):
            key = (self.sums[1:] - self.sums[np.maximum(at + 1 - n, 0)]) * self.back + n.astype(np.uint64)
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return key.view(np.int64), self.depth >= n


def _last_units(text: str, ids: _Ids) -> list[int]:
    """At least so many last units as the longest tail has, or all; reading begins between words near the end."""
    for length in (400, len(text)):
        start = max(0, len(text) - length)
        while 0 < start < len(text) and not text[start - 1].isspace():
            start += 1
        units = _units(text[start:], ids)
        if start == 0 or len(units) > _REACH + 2:
            break
    while units and units[-1] in (_STOP, _DOTS):
        units.pop()
    return units if start == 0 or len(units) > _REACH else _last_units_of_all(text, ids)


def _last_units_of_all(text: str, ids: _Ids) -> list[int]:
    units = _units(text, ids)
    while units and units[-1] in (_STOP, _DOTS):
        units.pop()
    return units


def _ended(text: str, ids: _Ids) -> tuple[list[int], bool, bool, bool]:
    """Last units of a value without what a cut leaves at its end; whether a cut mark ends it, whether dots do, whether it ends a statement."""
    near = max(0, len(text.rstrip()) - 200)
    dots = DOTS.search(text, near)
    marked = bool(CUT_MARK.search(text, near)) or bool(dots and dots.group().strip() == "..")
    return _last_units(text[: dots.start()] if dots else text, ids), marked, bool(dots), not dots and bool(TERMINAL.search(text, near))


JUDGED = "source string, text_key long, chars int, bytes int, marked boolean, dotted boolean, whole boolean, t0 long, t1 long, t2 long, before long, message boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value's lengths and key, whether a cut mark ends it, whether it ends a statement, and its tail keys."""
    ids = _Ids()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("text_key", "chars", "bytes", "marked", "dotted", "whole", "message")}
        units = []
        for text in batch.column(2).to_pylist():
            raw = text.encode()
            # a slot ends in a bracket or sign of its notation; other values are spared the pattern
            value = _AFTER_SLOT.sub("", text) if _MAY_CLOSE.search(text) and _SIGN.search(text) else text
            u, marked, dotted, whole = _ended(value, ids)
            units.append(u)
            message = not value.strip() or ((marked or not whole) and is_message(text))  # whole values are no cuts anyway
            for c, v in zip(out, (xxhash.xxh3_64_intdigest(raw) - (1 << 63), len(text), len(raw), marked, dotted, whole, message)):
                out[c].append(v)
        tails = _Tails(units)
        some = tails.sizes > 0
        last = (tails.ends - 1)[some]
        columns = []
        for rank in range(4):
            key, enough = tails.keys(rank)
            if rank == 3:  # of the unit before the last
                key, enough = np.append(0, key[:-1]), np.append(False, enough[:-1]) & (tails.depth > 1)
            column = np.full(len(units), None, object)
            column[some] = [int(k) if ok else None for k, ok in zip(key[last], enough[last])]
            columns.append(pa.array(column.tolist(), pa.int64()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.bool_()] * 4]
        a = {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)}
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), a["text_key"], a["chars"], a["bytes"], a["marked"], a["dotted"], a["whole"], *columns, a["message"]], ["id", *[c.split()[0] for c in JUDGED.split(", ")]])


COUNTED = "k long, ended long, inner long, low long, high long"


def _counted(asked: Broadcast):
    """How texts go on after the asked tails: a row per tail and batch with the number of texts that end a statement there, that go on, and their least and greatest keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts], np.int64)
            units = [_units(t, ids) for t in texts]
            for u in units:
                while u and u[-1] == _DOTS:
                    u.pop()
            tails = _Tails(units)
            last = np.zeros(len(tails.ids), bool)
            last[(tails.ends - 1)[tails.sizes > 0]] = True
            ended = np.append(tails.ids[1:] == _STOP, False)
            open_word = (tails.ids > _DOTS) & ~last
            found = []
            for rank in range(4):
                key, enough = tails.keys(rank)
                at = key & (FILTER_BITS - 1)
                hit = np.flatnonzero(enough & open_word & ((asked.value[at >> 6] >> (at & 63)) & 1 == 1))
                found.append(np.stack([key[hit], tails.owner[hit], ended[hit].astype(np.int64)]))
            k, owner, stop = np.concatenate(found, axis=1)
            order = np.lexsort((stop, owner, k))
            k, owner, stop = k[order], owner[order], stop[order]
            fresh = np.append(True, (k[1:] != k[:-1]) | (owner[1:] != owner[:-1]) | (stop[1:] != stop[:-1]))[: len(k)]
            k, owner, stop = k[fresh], owner[fresh], stop[fresh]
            tail, first = np.unique(k, return_index=True)
            if len(tail):
                columns = [np.add.reduceat(stop, first), np.add.reduceat(1 - stop, first), np.minimum.reduceat(keys[owner], first), np.maximum.reduceat(keys[owner], first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tail, *columns)], [c.split()[0] for c in COUNTED.split(", ")])

    return run


def _filter_of(keys: DataFrame) -> Broadcast:
    """A bit set of the keys, of fixed size whatever their number."""
    words = keys.select(F.expr(f"cast((k & {FILTER_BITS - 1}) >> 6 AS INT)").alias("w"), F.expr("shiftleft(1L, cast(k & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[r[0]] = r[1]
    return keys.sparkSession.sparkContext.broadcast(bits)


def length_spikes(lengths: DataFrame) -> DataFrame:
    """(source, unit, n) of the lengths at which a source cuts: spikes of its histograms.

    The histograms count characters and bytes apart. A length is a spike where far more
    values that do not end a statement have it than have the lengths around it. They are
    aggregated before anything is compared, so the size is that of the histograms.
    """
    each = lengths.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("n")))).alias("x"), "open")
    counts = each.groupBy("source", "x.unit", "x.n").agg(F.sum("open").alias("open"), F.count(F.lit(1)).alias("all"))
    near = counts.select("source", "unit", F.explode(F.expr("array(n-6, n-5, n-4, n-3, n+3, n+4, n+5, n+6)")).alias("n"), F.col("all").alias("beside")).groupBy("source", "unit", "n").agg((F.sum("beside") / 8).alias("beside"))
    return (
        counts.join(near, ["source", "unit", "n"], "left")
        .where((F.col("open") >= SPIKE) & (F.col("open") >= OVER * F.coalesce("beside", F.lit(0.0))) & (F.col("open") * 2 >= F.col("all")))
        .select("source", "unit", "n")
    )


def truncated(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """One row (id, source, truncated) per record with text, telling whether it was cut.

    A spike of the source's length histogram (characters or bytes) in a value that ends no
    statement tells a cut at a fixed length, a mark that a source leaves where it cuts
    tells one at any. For cuts without either, in a value without terminal punctuation, a
    tail decides that in several other texts is mostly followed by more text. Shares and
    numbers of different texts decide, so copies of a text change nothing. Of the corpus only tails that are
    asked for are counted.

    Null and blank texts give no rows. Unfilled template slots at the end are set aside
    first and messages of a site count as whole. Repeated rows of an id count once. A null
    source has its own histogram. Other columns are dropped.
    """
    base = df.where(F.length(F.trim(F.col(text))) > 0).select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("value"))
    kind = f"id {df.schema[id_col].dataType.simpleString()}, {JUDGED}"
    every = written(base.mapInArrow(_judged, kind), "judged")
    judged = every.where(~F.col("message"))
    spikes = length_spikes(judged.groupBy("source", "text_key").agg(F.first("chars").alias("chars"), F.first("bytes").alias("bytes"), F.first((~F.col("whole")).cast("int")).alias("open")))

    open_ends = judged.where(~F.col("whole") | F.col("marked"))
    asked = open_ends.where(~F.col("marked")).select("text_key", F.posexplode(F.array("t0", "t1", "t2")).alias("rank", "k")).where(F.col("k").isNotNull()).distinct()
    befores = open_ends.where(F.col("before").isNotNull()).select(F.col("before").alias("k"))
    seen = _filter_of(asked.select("k").unionByName(befores).distinct())
    tails = base.select("value").mapInArrow(_counted(seen), COUNTED).groupBy("k").agg(F.sum("ended").alias("ended"), F.sum("inner").alias("inner"), (F.min("low") < F.max("high")).alias("several"))
    tails = written(tails, "tails")
    at_spike = (
        open_ends.where(~F.col("whole"))
        .select("id", "source", "text_key", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("n")))).alias("x"))
        .select("id", "source", "text_key", "x.unit", "x.n")
        .join(spikes, ["source", "unit", "n"], "left_semi")
        .select("source", "text_key", F.lit(True).alias("spike"))
        .distinct()
    )
    # fixed endings are counted away from the spikes, where cut values pile up
    longest = F.coalesce("t0", "t1", "t2")
    usual = open_ends.join(at_spike, ["source", "text_key"], "left_anti").where(longest.isNotNull()).groupBy(longest.alias("longest")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_key").alias("texts"), F.first("before", ignorenulls=True).alias("before")).where(F.col("texts") >= USUAL)
    usual = usual.join(tails.select(F.col("k").alias("before"), "inner"), "before", "left").where(F.col("n") >= FIXED * F.coalesce("inner", F.col("n"))).select("longest", F.lit(True).alias("usual"))
    uses = F.coalesce("ended", F.lit(0)) + F.coalesce("inner", F.lit(0))
    best = (
        asked.join(tails, "k", "left")
        .groupBy("text_key")
        .agg(F.min_by(F.col("ended") / uses, F.when(F.col("several"), F.col("rank"))).alias("ends"), F.min_by(F.struct("k", F.coalesce("inner", F.lit(0)).alias("inner")), "rank").alias("x"))
        .join(usual, F.col("x.k") == F.col("longest"), "left")
        .select("text_key", F.when(F.coalesce("usual", F.lit(False)) & (F.col("x.inner") == 0), 1.0).otherwise(F.col("ends")).alias("ends"))
    )
    cut = (
        open_ends.join(best, "text_key", "left")
        .join(at_spike, ["source", "text_key"], "left")
        .where(F.col("marked") | (F.coalesce("spike", F.lit(False)) & (F.coalesce("ends", F.lit(0.0)) < SURELY_ENDS)) | (F.coalesce("ends", F.lit(0.0)) < ENDS))
        .select("id")
        .distinct()
    )
    return every.select("id", "source").distinct().join(cut.select("id", F.lit(True).alias("hit")), "id", "left").select("id", "source", F.coalesce("hit", F.lit(False)).alias("truncated"))


def truncation_rates(verdicts: DataFrame) -> DataFrame:
    """How often each source truncates: (source, n_records, n_truncated, share)."""
    return verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"))
