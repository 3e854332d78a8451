"""Subject areas of documents: weighted subject terms, a multi-pattern automaton, calibrated thresholds."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W\d_฀-๿぀-ヿ㐀-鿿](?:[^\W\d_฀-๿぀-ヿ㐀-鿿]|[̀-ͯऀ-ःऺ-ॏ'’-])*")
_RUN = re.compile(r"[ก-๛]+|[぀-ヿ㐀-鿿]+")
_CLAUSE = re.compile(r"[^\w\s'’̀-ͯऀ-ःऺ-ॏ฀-๿-]+|\d+")
_BREAK = re.compile(r"[.!?।]+[\"”’)\]]*(?= )|[。！？]+[」』”]?|(?<=[ก-๛]) +(?=[ก-๛])")
_INNER = re.compile(r"[^\W\d_]|[̀-ͯऀ-ःऺ-ॏ]")
_SPACELESS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
#: Longest term, in words, and in characters where words are not spaced.
WORDS, CHARS = 3, (3, 4, 5, 6, 8)
#: A term stands for a subject if at least this share of its labelled texts carry it.
PURITY = 0.72
#: Least score of a sentence to count for a subject.
SENTENCE = 1.6
#: A further subject needs two sentences and this share of those of the leading one ...
SHARE = 0.3
#: ... or one sentence of this score beside at most so many of the leading one (of any
#: counted score beside at most two), whatever its rank. Calibrated for the second subject
#: on records whose stored codes hold the leading one: above these limits they hold it as
#: often as where it has many sentences, below them at chance.
SINGLE, SINGLE_BESIDE = 2.4, 5


def _pieces(text: str) -> tuple[list[list[str]], list[str]]:
    """Words of each clause, and runs of characters of scripts without spaces."""
    clauses = _CLAUSE.split(text.lower())
    return [w for w in map(_WORD.findall, clauses) if w], [r for c in clauses for r in _RUN.findall(c)]


def _short_terms(pieces: tuple[list[list[str]], list[str]]) -> set[str]:
    """Single words, and the shortest runs of characters."""
    words, runs = pieces
    found = {w for clause in words for w in clause}
    for run in runs:
        for n in (CHARS[0],) if run[0] < "぀" else (2, CHARS[0]):
            found.update(run[i : i + n] for i in range(len(run) - n + 1))
    return found


def _long_terms(pieces: tuple[list[list[str]], list[str]], often: set[str]) -> set[str]:
    """Longer terms whose first parts all occur often; no other can occur often itself."""
    words, runs = pieces
    found: set[str] = set()
    for clause in words:
        ok = [w in often for w in clause]
        for i in range(len(clause) - 1):
            if ok[i] and ok[i + 1]:
                found.add(clause[i] + " " + clause[i + 1])
                found.update(" ".join(clause[i : i + n]) for n in range(3, WORDS + 1) if i + n <= len(clause) and all(ok[i + 2 : i + n]))
    for run in runs:
        for i in range(len(run) - CHARS[0]):
            if run[i : i + CHARS[0]] in often:
                found.update(run[i : i + n] for n in CHARS[1:] if i + n <= len(run))
    return found


@dataclass
class SubjectTerms:
    """Terms with their subject and weight, curated from labelled texts by a stated rule."""

    weights: dict[str, tuple[str, float]]

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, (subject, weight) in self.weights.items():
            a.add_word(term, (1 - len(term), subject, weight, bool(_SPACELESS.match(term))))
        if self.weights:
            a.make_automaton()
        return a


def curate_terms(labelled: Iterable[tuple[str, list[str]]], subjects: set[str]) -> SubjectTerms:
    """Weighted subject terms from (text, unreliable subject labels).

    A word n-gram (character n-gram where words are not spaced) becomes a term of a
    subject if enough texts hold it and at least ``PURITY`` of them carry the label. Its
    weight is the smoothed log odds of the subject against all others, so rare and
    exclusive terms weigh most. Wrong and partial labels spread evenly over subjects and
    only lower the odds. A longer term is kept only where it says more than its parts.
    """
    total: Counter = Counter()
    by: dict[str, Counter] = defaultdict(Counter)
    held = [(_pieces(text), own) for text, labels in labelled if text and (own := set(labels or ()) & subjects)]
    least = max(4, len(held) // 1500)
    short = [_short_terms(p) for p, _ in held]
    for terms in short:
        total.update(terms)
    often = {t for t, n in total.items() if n >= least}
    every = [(terms & often) | _long_terms(p, often) for terms, (p, _) in zip(short, held)]
    for terms, few in zip(every, short):
        total.update(terms - few)
    often = {t for t, n in total.items() if n >= least and len(t) > 1}
    for terms, (_, own) in zip(every, held):
        for subject in own:
            by[subject].update(terms & often)
    best: dict[str, tuple[int, str]] = {}
    for subject in sorted(by):
        for term, k in by[subject].items():
            if k > best.get(term, (0, ""))[0]:
                best[term] = (k, subject)
    kept: dict[str, tuple[str, float]] = {}
    for term in sorted(best, key=lambda t: (len(t), t)):
        n = total[term]
        k, subject = best[term]
        if k < PURITY * n:
            continue
        weight = round(math.log((k + 0.5) / (n - k + 0.5 + 8 / n)), 3)
        words = term.split(" ")
        if len(words) > 1:
            parts = [kept.get(" ".join(words[1:])), kept.get(" ".join(words[:-1]))]
            if any(p and p[0] == subject and p[1] >= weight for p in parts):
                continue
        elif _SPACELESS.match(term) and any(p and p[0] == subject and p[1] >= weight for p in (kept.get(term[1:]), kept.get(term[:-1]))):
            continue
        if weight > 0.5:
            kept[term] = (subject, weight)
    return SubjectTerms(kept)


class _Inside(dict):
    """Whether a character goes on with a word."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = bool(_INNER.match(c))
        return found


_INSIDE = _Inside({"": False})


def _whole_terms(low: str, automaton: ahocorasick.Automaton) -> list[tuple[int, str, float]]:
    """(start, subject, weight) of the terms in a text, in order; of those that overlap, the longest.

    Terms inside longer ones count where the longer one does not end with a word, so word
    ends are looked at before lengths.
    """
    hits = []
    padded = f" {low} "
    inside = _INSIDE
    for end, (back, subject, weight, spaceless) in automaton.iter(low):
        if spaceless or not (inside[padded[end + 2]] or inside[padded[end + back]]):
            hits.append((back, end + back, end, subject, weight))
    hits.sort()
    taken = bytearray(len(low))
    kept = []
    for back, start, end, subject, weight in hits:
        if not (taken[start] or taken[end]):  # what is taken is not shorter, so it would cover an end
            taken[start : end + 1] = b"\1" * (1 - back)
            kept.append((start, subject, weight))
    kept.sort()
    return kept


def treated_subjects(text: str, automaton: ahocorasick.Automaton, sentence: float = SENTENCE) -> list[tuple[str, float]]:
    """Subjects a text treats with their scores (share of the sentences that speak of a subject)."""
    low = " ".join(text.lower().split())
    ends = [m.end() for m in _BREAK.finditer(low)]
    ends.append(len(low))
    scores: dict[str, float] = {}
    sentences: Counter = Counter()
    best: dict[str, float] = defaultdict(float)
    at = 0

    def close() -> None:
        if scores:
            for s, v in scores.items():
                if v >= sentence:
                    sentences[s] += 1
                if v > best[s]:
                    best[s] = v
            scores.clear()

    for start, subject, weight in _whole_terms(low, automaton):
        while start >= ends[at]:
            close()
            at += 1
        scores[subject] = scores.get(subject, 0.0) + weight
    close()
    if not best:
        return []
    if not sentences:
        hinted = sorted(s for s in best if best[s] >= sentence / 2)
        return [(s, round(1 / len(hinted), 6)) for s in hinted]
    spoken = sum(sentences.values())
    lead = max(sentences.values())
    chosen = []
    for s, n in sentences.items():
        single = n == 1 and (lead <= 2 or (lead <= SINGLE_BESIDE and best[s] >= SINGLE))
        if n == lead or (n >= 2 and n >= SHARE * lead) or single:
            chosen.append((s, round(n / spoken, 6)))
    return sorted(chosen)


def agreement(labelled: Iterable[tuple[str, list[str]]], automaton: ahocorasick.Automaton, sentence: float) -> float:
    """F1 of the assigned subjects against stored labels when a sentence counts from ``sentence`` on."""
    both = found = stored = 0
    for text, labels in labelled:
        got, want = {s for s, _ in treated_subjects(text, automaton, sentence)}, set(labels)
        both, found, stored = both + len(got & want), found + len(got), stored + len(want)
    return 2 * both / max(1, found + stored)


def calibrated_sentence(labelled: list[tuple[str, list[str]]], automaton: ahocorasick.Automaton, grid: Iterable[float] = (0.8, 1.2, 1.6, 2.0, 2.4, 3.0)) -> dict[float, float]:
    """Agreement with stored labels for every threshold of a grid, on records the terms were not fitted on.

    ``SENTENCE`` was chosen by it: the greatest value whose agreement is within two
    thousandths of the best, so that weak sentences are left out as long as that costs nothing. It is a
    constant and not fitted at each call, so that tables of all sizes are judged alike.
    """
    return {t: agreement(labelled, automaton, t) for t in grid}


def assign_subjects(df: DataFrame, key: str, text: str, terms: Broadcast) -> DataFrame:
    """One row (key, subject, score) per subject that a text treats.

    One pass of the automaton over every whole text in a narrow Arrow stage; the term
    list is fitted on a bounded sample and therefore bounded. Texts without any subject
    term, null and empty texts give no rows; repeated rows give theirs each.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = terms.value.automaton()
        for batch in batches:
            rows, names, scores = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                for s, v in treated_subjects(t, automaton) if t else ():
                    rows.append(i)
                    names.append(s)
                    scores.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "subject", "score"])

    out = T.StructType([T.StructField("k", kind), T.StructField("subject", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(key, text).mapInArrow(run, out).withColumnRenamed("k", key)
