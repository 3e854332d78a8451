"""Language of documents and of the segments of mixed documents.

One interpolated Kneser-Ney character model per language, all held in one set of sorted
hash arrays: row i of the probability matrix of order n belongs to the i-th hash of that
order and has a column per language, so one lookup serves all languages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.sentences import sentence_spans

#: Runs that are scored as one unit. Thai is cut before its leading vowels so that units repeat.
TOKEN = re.compile(r"[^\W\d_฀-๿぀-ヿㇰ-ㇿ㐀-鿿가-힯](?:[^\W\d_฀-๿぀-ヿ㐀-鿿가-힯]|[̀-ͯऀ-ॿ'’-])*|[เ-ไ]?[ก-ฯะ-ฺๅ-๎](?:[ะ-ฺๅ-๎]|[ก-ฮ](?![ะ-ฺๅ-๎])){0,3}|[ก-๛]|[㐀-鿿]{1,2}|[぀-ヿㇰ-ㇿ]+|[가-힯]+")
# Usual notations of the ten languages: ISO 639-1, 639-2/3 and English names. Fixed values.
NOTATIONS = {
    "en": "en eng english", "ms": "ms msa may zsm malay", "id": "id ind in indonesian", "tl": "tl tgl fil tagalog filipino", "vi": "vi vie vietnamese",
    "th": "th tha thai", "ja": "ja jpn jp japanese", "ko": "ko kor kr korean", "zh": "zh zho chi cmn chinese mandarin", "hi": "hi hin hindi",
}
_CODE_OF = {n: code for code, names in NOTATIONS.items() for n in names.split()}
DISCOUNT = 0.75
ORDER = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def label_code(label: str | None) -> str | None:
    """The language code that a stored label names in any usual notation, or None."""
    if not label:
        return None
    low = label.strip().lower()
    return _CODE_OF.get(low) or _CODE_OF.get(re.split(r"[-_ (]", low, maxsplit=1)[0])


def _windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n codes that end at each position (positions before n are padding)."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for k in range(n):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[k:] = codes[: len(codes) - k] + np.uint64(1)
            h = (h ^ (shifted * np.uint64(2 * k + 1) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _encoded(tokens: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all tokens, each between two boundary marks, and the token each belongs to."""
    joined = "\x02" + "\x03\x02".join(tokens) + "\x03"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.cumsum(codes == 2) - 1


@dataclass
class LanguageModel:
    """Sorted hash arrays of all orders with one probability column per language.

    ``keys[n]`` are the sorted hashes of the (n+1)-grams seen in any language,
    ``logs[n]`` their interpolated log probabilities, ``backs[n]`` the log weight given to
    the lower order after that context. ``reject`` is the calibrated highest cross-entropy
    (nats a character) a text of a known language has, ``spread`` the scale of confidence.
    """

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    backs: list[np.ndarray]
    floor: float
    reject: float = 9.0

    def token_costs(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed negative log probability of each token under each language, and its number of characters."""
        codes, owner = _encoded(tokens)
        start = np.flatnonzero(codes == 2)
        depth = np.arange(len(codes)) - start[owner]
        logp = np.full((len(codes), len(self.languages)), self.floor, np.float32)
        context = None
        for n in range(1, len(self.keys) + 1):
            h = _windows(codes, n)
            at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            hit = (self.keys[n - 1][at] == h) & (depth >= n - 1)
            if context is not None:
                rows, seen = context  # the (n-1)-gram that ends one position earlier
                prev = np.zeros(len(codes), bool)
                prev[1:] = seen[:-1]
                miss = prev & ~hit & (depth >= n - 1)
                where = np.flatnonzero(miss)
                logp[where] += self.backs[n - 2][rows[where - 1]]
            logp[hit] = self.logs[n - 1][at[hit]]
            context = (at, hit)
        logp[codes == 2] = 0
        return -np.add.reduceat(logp, start, axis=0), np.diff(np.append(start, len(codes))) - 1


def fit_language_model(samples: Iterable[tuple[str, str]], order: int = ORDER) -> LanguageModel:
    """Interpolated Kneser-Ney models of all languages from (language, text) pairs; a model of none from none."""
    by: dict[str, Counter] = defaultdict(Counter)
    for lang, text in samples:
        if lang and text:
            by[lang].update(TOKEN.findall(text.lower()))
    languages = sorted(by)
    if not languages:
        return LanguageModel([], [], [], [], -20.0)
    grams: list[dict[str, Counter]] = [{} for _ in range(order)]
    for lang in languages:
        full: list[Counter] = [Counter() for _ in range(order)]
        for token, times in by[lang].items():
            s = "\x02" + token + "\x03"
            for i in range(len(s)):
                for n in range(1, order + 1):
                    if i + 1 >= n:
                        full[n - 1][s[i + 1 - n : i + 1]] += times
        for n in range(order):
            if n == order - 1:
                grams[n][lang] = full[n]
            else:
                # continuation counts; grams that open with the boundary have no left neighbour and keep their counts
                c: Counter = Counter(g[1:] for g in full[n + 1])
                c.update({g: k for g, k in full[n].items() if g[0] == "\x02"})
                grams[n][lang] = c
    keys, logs, backs = [], [], []
    lower: dict[str, np.ndarray] = {}
    alphabet = len({g for lang in languages for g in grams[0][lang]}) + 1
    floor = np.log(DISCOUNT * 0.02 / (alphabet * 50))
    L = len(languages)
    for n in range(order):
        union = sorted({g for lang in languages for g in grams[n][lang]})
        total = {lang: Counter() for lang in languages}
        kinds = {lang: Counter() for lang in languages}
        for lang in languages:
            for g, k in grams[n][lang].items():
                total[lang][g[:-1]] += k
                kinds[lang][g[:-1]] += 1
        probs: dict[str, np.ndarray] = {}
        for g in union:
            ctx = g[:-1]
            p = np.empty(L)
            base = lower[g[1:]] if n else None
            for j, lang in enumerate(languages):
                t = total[lang].get(ctx, 0)
                under = base[j] if n else np.exp(floor)
                p[j] = under if not t else max(grams[n][lang].get(g, 0) - DISCOUNT, 0) / t + DISCOUNT * kinds[lang][ctx] / t * under
            probs[g] = p
        codes = [np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64) for g in union]
        hashes = np.array([_windows(c, n + 1)[-1] for c in codes], np.uint64)
        rank = np.argsort(hashes)
        keys.append(hashes[rank])
        logs.append(np.log(np.array([probs[union[i]] for i in rank])).astype(np.float32))
        if n:
            # weight of the lower order after each (n)-gram context of the order before
            table = np.zeros((len(previous), L), np.float32)
            for i, g in enumerate(previous):
                for j, lang in enumerate(languages):
                    t = total[lang].get(g, 0)
                    if t:
                        table[i, j] = np.log(DISCOUNT * kinds[lang][g] / t)
            backs.append(table)
        previous = [union[i] for i in rank]
        lower = probs
    return LanguageModel(languages, keys, logs, backs, float(floor))


class Scorer:
    """Scores texts under a model, remembering the costs of units already met (bounded memory)."""

    def __init__(self, model: LanguageModel, remember: int = 400_000):
        self.model, self.remember = model, remember
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.costs = np.zeros((0, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def costs_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: total cost under each language and number of characters scored."""
        slot = self.slot
        if len(slot) > self.remember:
            self._clear()
            slot = self.slot
        found = [TOKEN.findall(t) for t in texts]
        new: dict[str, int] = {}
        ids: list[int] = []
        base = len(slot)
        for tokens in found:
            for w in tokens:
                i = slot.get(w)
                if i is None:
                    i = new.get(w)
                    if i is None:
                        i = new[w] = base + len(new)
                ids.append(i)
        if new:
            costs, sizes = self.model.token_costs(list(new))
            self.costs = np.concatenate([self.costs, costs])
            self.sizes = np.concatenate([self.sizes, sizes])
            slot.update(new)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        cost = np.zeros((len(texts), len(self.model.languages)))
        size = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(lengths)
        if len(ids):
            at = np.cumsum(lengths)[full] - lengths[full]
            index = np.array(ids)
            cost[full] = np.add.reduceat(self.costs[index], at, axis=0)
            size[full] = np.add.reduceat(self.sizes[index], at)
        return cost, size


#: Cost, in nats, of changing the language between two sentences; keeps one odd heading or name from opening a segment.
SWITCH = 9.0


def segment(costs: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The cheapest sequence of languages over the sentences of one text (dynamic programming)."""
    n, L = costs.shape
    best = costs[0].copy()
    back = np.zeros((n, L), np.int64)
    for i in range(1, n):
        j = int(best.argmin())
        jump = best[j] + switch
        stay = best <= jump
        back[i] = np.where(stay, np.arange(L), j)
        best = np.where(stay, best, jump) + costs[i]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


SEGMENTS = "seg_no int, start_char int, end_char int, lang string, confidence double, mixed boolean, right boolean"


def identify(df: DataFrame, key: str, text: str, label: str | None, model: Broadcast, whole: bool = False, only_cases: bool = False, closest: bool = True) -> DataFrame:
    """One row per language segment of every text: offsets, language, confidence.

    A segment is a longest run of whole sentences in one language. ``confidence`` is the
    posterior of the language given the segment, and 0 where the length-normalised
    cross-entropy of the best language is above the calibrated limit (rejected; the
    closest language is still named if ``closest``, else it is null). ``right`` tells whether ``label`` names the language
    of an unmixed text. ``whole`` takes each text as one segment (titles); ``only_cases``
    keeps only texts that are mixed or whose label is not right.

    One narrow Arrow stage without shuffle; the model is fitted on a bounded sample and
    therefore bounded itself, so it is broadcast. Null, empty and letterless texts give
    no rows, nor does a model of no languages; repeated rows give their rows each. Ties go
    to the language first in order. Other columns are dropped.
    """
    kind = df.schema[key].dataType
    picked = [c for c in (key, text, label) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        names, reject = scorer.model.languages, scorer.model.reject
        for batch in batches:
            texts = batch.column(1).to_pylist() if names else [None] * batch.num_rows
            labels = batch.column(2).to_pylist() if label else [None] * len(texts)
            spans = [([(0, len(t))] if t and t.strip() else []) if whole else sentence_spans(t) for t in texts]
            counts = np.fromiter(map(len, spans), np.int64, len(spans))
            low = [t.lower() if t else "" for t in texts]
            low = [a if len(a) == len(t or "") else t for a, t in zip(low, texts)]
            cost, size = scorer.costs_of([t[a:b] for t, s in zip(low, spans) for a, b in s])
            argmin = cost.argmin(axis=1) if len(cost) else np.zeros(0, np.int64)
            ends = np.cumsum(counts)
            out: list[list] = [[] for _ in range(8)]
            for i in np.flatnonzero(counts):
                a, b = int(ends[i] - counts[i]), int(ends[i])
                local = argmin[a:b]
                scored = size[a:b] > 0
                if not scored.any():
                    continue
                path = np.full(b - a, local[0]) if (local == local[0]).all() else segment(cost[a:b])
                edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), b - a]
                mixed = len(edges) > 2
                right = not mixed and label_code(labels[i]) == names[path[0]]
                if only_cases and right:
                    continue
                for k in range(len(edges) - 1):
                    c = cost[a + edges[k] : a + edges[k + 1]].sum(axis=0)
                    n = max(1, int(size[a + edges[k] : a + edges[k + 1]].sum()))
                    lang = int(path[edges[k]])
                    known = c[lang] / n <= reject
                    sure = 1.0 / np.exp(np.minimum(c[lang] - c, 0)).sum() if known else 0.0
                    for column, v in zip(out, (i, k + 1, spans[i][edges[k]][0], spans[i][edges[k + 1] - 1][1], names[lang] if known or closest else None, float(round(sure, 6)), mixed, right)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string()), pa.array(out[5], pa.float64()), pa.array(out[6], pa.bool_()), pa.array(out[7], pa.bool_())],
                ["k", "seg_no", "start_char", "end_char", "lang", "confidence", "mixed", "right"],
            )

    fields = T._parse_datatype_string(SEGMENTS).fields
    return df.select(*picked).mapInArrow(run, T.StructType([T.StructField("k", kind), *fields])).withColumnRenamed("k", key)


#: The limit of rejection: this quantile of the cross-entropies of held-out sentences, times a slack for text of other kinds.
KNOWN, SLACK = 0.99, 1.4
#: One sentence in so many is held out for it.
HELD_OUT = 5


def calibrated(model: LanguageModel, held_out: Iterable[str], quantile: float = KNOWN, slack: float = SLACK) -> LanguageModel:
    """Set the rejection limit from texts of known languages that the model has not seen."""
    if not model.languages:
        return model
    cost, size = Scorer(model).costs_of([t.lower() for t in held_out if t])
    known = size > 0
    if known.any():
        model.reject = float(np.quantile(cost[known].min(axis=1) / size[known], quantile) * slack)
    return model


def fit_with_limit(seed: list[tuple[str, str]], more: list[tuple[str, str]]) -> LanguageModel:
    """Models of all samples, with the limit that models of four fifths of them need for the rest."""
    samples = [*seed, *more]
    part = fit_language_model([x for i, x in enumerate(samples) if i % HELD_OUT])
    model = fit_language_model(samples)
    model.reject = calibrated(part, [t for i, (_, t) in enumerate(samples) if i % HELD_OUT == 0]).reject
    return model
