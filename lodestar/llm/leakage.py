"""Evaluation passages inside training documents."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Units (words; single characters where words are not spaced) in a fingerprinted window: the
#: shortest unchanged run that the exact check builds on, so no stretch is without one.
WINDOW = 3
#: Fingerprints within this Hamming distance are candidates; one more block than this makes the search exact.
RADIUS = 3
BLOCKS = RADIUS + 1
#: A matching stretch has at least this many units, in words and in single characters.
STRETCH_WORDS, STRETCH_CHARS = 6, 10
#: A document holds an item from this share of its units on.
HELD = 0.5
#: A sentence in at least this many items is a phrase of the test, not of an item.
COMMON = 3
#: Items above this number are refused: the index is broadcast.
MAX_ITEMS = 100_000
_MARKS = re.compile(r"[̀-ͯ็-๎゙゚​-‏­⁠﻿]")
# Letters of other scripts that look like Latin ones, and the Latin ones. Fixed values.
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтαοεικνρτυχγ", "aeopcyxijshdqwbkmhtaoeikvptuxy")
_UNIT = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W_฀-๿぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+|$)")


def folded_units(text: str) -> list[str]:
    """Units of a text without differences of case, marks, spacing and look of characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", text).casefold().translate(_LOOKALIKES)
    else:
        text = text.lower()
    return _UNIT.findall(text)


def _hashes(units: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(units), np.uint64)
    for i, u in enumerate(units):
        h = known.get(u)
        if h is None:
            h = known[u] = xxhash.xxh3_64_intdigest(u)
        out[i] = h
    return out


def window_fingerprints(h: np.ndarray) -> np.ndarray:
    """64-bit SimHash of every window of ``WINDOW`` units, over its units and their adjacent pairs."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(31)

    def summed(x: np.ndarray, width: int) -> np.ndarray:
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        total = np.zeros((len(x) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        return 2 * (total[width:] - total[:-width]) - width

    votes = summed(h, WINDOW) + summed(pair, WINDOW - 1)
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


@dataclass
class ItemIndex:
    """Fingerprints of all windows of all items, by block value for multi-index Hamming search."""

    ids: list[int]
    units: list[list[str]]
    weights: list[np.ndarray]
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    order: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (asked print, indexed print) pairs within the radius, each at least once.

        Two fingerprints within ``RADIUS`` bits agree wholly on at least one of
        ``RADIUS + 1`` blocks, so looking each block up finds them all.
        """
        at, others = [], []
        for b in range(BLOCKS):
            key = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            lo, hi = self.bounds[b][key.astype(np.int64)], self.bounds[b][key.astype(np.int64) + 1]
            n = hi - lo
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            rows = np.repeat(hit, n[hit])
            step = np.arange(len(rows)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
            other = self.order[b][np.repeat(lo[hit], n[hit]) + step]
            close = np.bitwise_count(prints[rows] ^ self.prints[other]) <= RADIUS
            at.append(rows[close])
            others.append(other[close])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(others)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs within the radius."""
        at, other = self.near(prints)
        return at, self.owner[other]

    def holders(self, prints: list[np.ndarray], least: float) -> list[tuple[int, int]]:
        """(document, item) pairs that may share at least ``least`` of the item, given the prints of each document.

        All units that ``held_share`` counts lie in unchanged runs of ``WINDOW`` units, and a
        window covers no more units than that. So a document that holds the share matches
        at least ``least * units / WINDOW`` windows of the item; no other pair is left out.
        """
        flat = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        if not len(flat) or not len(self.prints):
            return []
        asked, place = np.unique(flat, return_inverse=True)
        at, other = self.near(asked)
        order = np.argsort(at, kind="stable")
        at, other = at[order], other[order]
        lo, hi = np.searchsorted(at, np.arange(len(asked))), np.searchsorted(at, np.arange(len(asked)), side="right")
        found = np.flatnonzero(hi[place] > lo[place])
        of = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        pairs = np.unique(of[found] * len(asked) + place[found])
        doc, place = pairs // len(asked), pairs % len(asked)
        n = hi[place] - lo[place]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = np.unique(np.repeat(doc, n) * len(self.prints) + other[np.repeat(lo[place], n) + step])
        doc, item = windows // len(self.prints), self.owner[windows % len(self.prints)]
        pairs, matched = np.unique(doc * len(self.units) + item, return_counts=True)
        enough = matched * WINDOW >= least * np.array([len(u) for u in self.units])[pairs % len(self.units)] - 1e-9
        return [(int(p // len(self.units)), int(p % len(self.units))) for p in pairs[enough]]


def index_items(items: Iterable[tuple[int, str]]) -> ItemIndex:
    """Index the held-out items. Units of sentences common to many items weigh nothing."""
    rows = [(i, t) for i, t in items if i is not None and t and t.strip()]
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items; index them in parts")
    seen: Counter = Counter()
    split = []
    for _, t in rows:
        parts = [u for u in (folded_units(m.group()) for m in _SENTENCE.finditer(t)) if u]
        split.append(parts)
        seen.update({tuple(p) for p in parts})
    index = ItemIndex([i for i, _ in rows], [[u for p in parts for u in p] for parts in split], [np.concatenate([np.full(len(p), float(seen[tuple(p)] < COMMON)) for p in parts] or [np.zeros(0)]) for parts in split])
    known: dict[str, int] = {}
    prints = [window_fingerprints(_hashes(u, known)) for u in index.units]
    keep = [np.array([w[k : k + WINDOW].any() for k in range(len(p))], bool) for p, w in zip(prints, index.weights)]
    index.prints = np.concatenate([p[k] for p, k in zip(prints, keep)] or [np.zeros(0, np.uint64)])
    index.owner = np.concatenate([np.full(int(k.sum()), n) for n, k in enumerate(keep)] or [np.zeros(0, np.int64)]).astype(np.int64)
    for b in range(BLOCKS):
        key = ((index.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        index.order.append(order)
        index.bounds.append(np.searchsorted(key[order], np.arange(65537)))
    return index


def held_share(doc: list[str], item: list[str], weights: np.ndarray) -> float:
    """Share of an item's units that a document holds in order, in running stretches.

    A stretch follows one alignment of the two texts; a single differing unit inside it
    does not end it. The best chain of stretches in item order counts. Units weigh 1, or 0
    in sentences common to many items.
    """
    if not item:
        return 0.0
    k = WINDOW
    places: dict[tuple, list[int]] = defaultdict(list)
    for j in range(len(item) - k + 1):
        places[tuple(item[j : j + k])].append(j)
    marks: dict[int, list[int]] = defaultdict(list)
    for i in range(len(doc) - k + 1):
        for j in places.get(tuple(doc[i : i + k]), ()):
            marks[i - j].append(j)
    spans = []
    for shift, js in marks.items():
        start = prev = js[0]
        runs = []
        for j in js[1:]:
            if j - (prev + k) > 1:
                runs.append((start, prev + k))
                start = j
            prev = j
        runs.append((start, prev + k))
        for a, b in runs:
            least = STRETCH_CHARS if len(item[a]) == 1 and not item[a].isascii() else STRETCH_WORDS
            if b - a >= least:
                spans.append((a, b, a + shift))
    spans.sort(key=lambda s: (s[1], s[0]))
    total = np.concatenate([[0.0], np.cumsum(weights)])
    matched = [sum(weights[j] for j in range(a, b) if doc[j + i - a] == item[j]) for a, b, i in spans]
    best: list[float] = []
    for n, (a, b, i) in enumerate(spans):
        top = matched[n]
        for m in range(n):
            pa_, pb, pi = spans[m]
            if pi + (pb - pa_) <= i + 2 and pa_ < a:
                overlap = total[min(pb, b)] - total[a] if pb > a else 0.0
                top = max(top, best[m] + max(0.0, matched[n] - overlap))
        best.append(top)
    return max(best, default=0.0) / len(item)


def leaked_items(df: DataFrame, key: str, text: str, index: Broadcast, least: float = HELD) -> DataFrame:
    """One row (key, item_id, share) per document and item it holds from ``least`` on.

    Every window of every whole text is fingerprinted and searched in the item index (a
    stated query set against all rows); candidates are verified exactly by the weighted
    share of the item's shingles found in order. One narrow Arrow stage, no shuffle. Null
    and empty texts and texts shorter than a window give no rows; repeated rows of a key
    give theirs each.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        known: dict[str, int] = {}
        for batch in batches:
            rows, names, shares = [], [], []
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts) if len(items.prints) else 0, 256):
                docs = [folded_units(t) if t else [] for t in texts[a : a + 256]]
                if len(known) > 500_000:
                    known.clear()
                for d, n in items.holders([window_fingerprints(_hashes(d, known)) for d in docs], least):
                    share = held_share(docs[d], items.units[n], items.weights[n])
                    if share >= least:
                        rows.append(a + d)
                        names.append(items.ids[n])
                        shares.append(round(float(share), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.int64()), pa.array(shares, pa.float64())], ["k", "item_id", "share"])

    out = T.StructType([T.StructField("k", kind), T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())])
    return df.select(key, text).mapInArrow(run, out).withColumnRenamed("k", key)
