"""Spellings of one organisation or person: blocking, verification, star clustering."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import written

#: Length of the padded q-grams of the distinctive part of a name.
Q = 2
#: Rows and bands of the MinHash signature; see ``collision_curve`` for how they were tuned.
ROWS, BANDS = 3, 40
#: The same for single letters, which swaps leave as they are.
LETTER_ROWS, LETTER_BANDS = 12, 8
#: Distinctive parts of fewer letters may differ by one edit (none below ``SHORTEST``), others by two.
LONG, SHORTEST = 11, 5
#: Parts of up to this many letters meet by what is left of them without as many letters as edits are allowed, longer ones by bands.
LISTED = 24
#: Least Monge-Elkan similarity of two distinctive parts.
SIMILAR = 0.84
# Words of institution names with their usual short forms. Fixed values.
INSTITUTION = {
    "university": "univ uni", "institute": "inst instt", "institution": "instn", "technology": "tech technol", "technologies": "", "research": "res rsch", "centre": "ctr cntr center", "laboratory": "lab", "laboratories": "labs",
    "national": "natl nat", "college": "coll", "polytechnic": "poly polytech", "school": "sch", "academy": "acad", "department": "dept", "ministry": "min", "agency": "agcy", "authority": "auth", "council": "cncl", "board": "bd", "office": "off", "foundation": "fdn found",
    "company": "co coy", "corporation": "corp", "limited": "ltd", "private": "pvt pte", "incorporated": "inc", "sendirian": "sdn", "berhad": "bhd", "group": "grp", "holdings": "hldgs", "enterprise": "ent", "industries": "ind inds", "systems": "sys", "services": "svcs", "solutions": "soln",
    "development": "dev devt", "transfer": "trf", "innovation": "innov", "engineering": "engg eng engrg", "agricultural": "agri agric", "agriculture": "", "medical": "med", "devices": "dev", "advanced": "adv", "materials": "mat mats", "marine": "mar", "food": "", "rural": "", "textile": "text", "energy": "", "biosciences": "biosci", "science": "sci", "sciences": "scis",
    "international": "intl", "association": "assn assoc", "society": "soc", "hospital": "hosp", "management": "mgmt", "administration": "admin", "bureau": "bur", "division": "div", "state": "", "federal": "fed", "central": "cent", "applied": "appl", "studies": "stud", "health": "", "industrial": "indl", "manufacturing": "mfg",
}
_STOP = frozenset("the of for and in on at de la &".split())
_TITLES = frozenset("mr mrs ms miss dr er prof professor sir madam dato datuk tan sri ir eng shri smt engr".split())
_FULL = {short: full for full, shorts in INSTITUTION.items() for short in [full, *shorts.split()]}
_LONG = [w for w in INSTITUTION if len(w) > 3]


def folded(name: str) -> str:
    """A name without case, marks and kinds of white space."""
    x = unicodedata.normalize("NFKD", name).casefold()
    return re.sub(r"\s+", " ", "".join(c for c in x if not unicodedata.combining(c))).replace("’", "'").strip()


def within(a: str, b: str, most: int) -> bool:
    """Whether the restricted Damerau-Levenshtein distance is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most and (not before or min(last) > most):
            return False
        before, last = last, row
    return last[-1] <= most


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Symmetric Monge-Elkan similarity over the tokens of two names, spaces between tokens aside."""
    if not a or not b:
        return 0.0
    one = sum(max(jaro_winkler(x, y) for y in b) for x in a) / len(a)
    two = sum(max(jaro_winkler(x, y) for y in a) for x in b) / len(b)
    return max(min(one, two), jaro_winkler("".join(a), "".join(b)))


def collision_curve(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """Chance that two sets of this Jaccard similarity share a band.

    Bands serve parts of more than ``LISTED`` letters. Two swaps of neighbours, the edits
    that cost most, leave a similarity of 0.6 to the padded 2-grams of 23 letters; the curve
    gives 0.9999 there. In short parts the curve is too low (two swaps in eleven letters
    leave 0.33, which it gives 0.78) and 2-grams of unlike parts agree too often: pairs
    grow with the square of the names. Those meet by ``shortened``, which misses no edit.
    """
    return 1 - (1 - similarity**rows) ** bands


def allowed_edits(a: str, b: str) -> int:
    least = min(len(a), len(b))
    return 2 if least >= LONG else 1 if least >= SHORTEST else 0


def shortened(core: str) -> set[str]:
    """A part and all that is left of it without as many letters as edits are allowed.

    A substitution or a swap is undone by leaving out a letter of both parts, a letter added
    by leaving it out of one; so parts within the allowed edits have one of these in common.
    """
    left = {core, *(core[:i] + core[i + 1 :] for i in range(len(core)))}
    return left | {core[:i] + core[i + 1 : j] + core[j + 1 :] for i, j in combinations(range(len(core)), 2)} if len(core) >= LONG else left


@lru_cache(100_000)
def _institution_word(token: str) -> str | None:
    found = _FULL.get(token) or _FULL.get(token.replace("'", ""))
    if found:
        return found
    if len(token) >= 4:
        for most in (1, 2):
            for w in _LONG:
                if abs(len(w) - len(token)) <= most and (most == 1 or (len(w) >= 8 and len(token) >= 7)) and within(token, w, most):
                    return w
    return None


class NameParser:
    """Splits a name into its distinctive part and what qualifies it.

    An organisation has a kind (the initials of its institution words, however they are
    abbreviated) and a distinctive part; a place after the last comma is set aside. A
    person has a surname as distinctive part, possible given names (nicknames resolved)
    and initials; titles are set aside.
    """

    def __init__(self, nicknames: Iterable[tuple[str, str]]):
        self.given: dict[str, set[str]] = {}
        self.initials: dict[str, set[str]] = {}
        for full, nick in nicknames:
            if full and nick:
                f, n = folded(full), folded(nick)
                self.given.setdefault(n, set()).add(f)
                self.given.setdefault(f, set()).add(f)
                self.initials.setdefault(f, {f[0]}).add(n[0])
        self.names = sorted(self.given)

    def given_of(self, token: str) -> set[str]:
        if token in self.given:
            return self.given[token]
        if len(token) >= 5:
            for n in self.names:
                if len(n) >= 5 and within(token, n, 1):
                    return self.given[n]
        return set()

    def parse(self, name: str) -> tuple[str, list[str], str, list[str], str]:
        """(kind, tokens of the distinctive part, possible first initials, possible given names, middle initials); kind is "person" or the initials of the institution words."""
        x = folded(name)
        inside = re.search(r"\(([^()]*)\)", x)
        parts = [p for p in re.split(r"[,;]", re.sub(r"\([^()]*\)", " ", x)) if re.search(r"\w", p)]
        if inside and re.search(r"\w", inside.group(1)):
            parts.append(inside.group(1))
        read = []
        for p in parts:
            tokens = [t.strip("'") for t in re.findall(r"[^\W_][\w']*", p)]
            tokens = [t for t in tokens if t and t not in _STOP]
            words = [(t, _institution_word(t)) for t in tokens]
            # beside institution words one or two letters are initials of further ones
            read.append([(t, w or ("#" + t if len(t) <= 2 and t not in self.given else None)) for t, w in words] if any(w for _, w in words) else words)
        if not any(w for p in read for _, w in p):
            # an acronym counts as institution word where the rest is a name of its own
            for p in read:
                for i, (t, _) in enumerate(p):
                    alone = len(p) == 1 and len(read) > 1
                    if 2 <= len(t) <= 5 and (alone or i in (0, len(p) - 1)) and t not in self.given and t not in _TITLES and not any(q in self.given for r in read for q, _ in r):
                        if sum(len(q) for r in read for q, _ in r) - len(t) >= 6 and len(t) <= 4:
                            p[i] = (t, "#" + t)
                            break
        kinds = [[w for _, w in p if w] for p in read]
        cores = [[t for t, w in p if not w] for p in read]
        if any(kinds):
            own = next((i for i, (k, c) in enumerate(zip(kinds, cores)) if c and k), None)
            if own is None:  # kind and name stand apart
                own = next((i for i, c in enumerate(cores) if c), 0)
            words = next((k for k in kinds if k), [])
            initials = "".join(w[1:] if w[0] == "#" else w[0] for w in words)
            extra = [t for t in cores[own] if len(t) <= 2]
            core = [t for t in cores[own] if len(t) > 2] or cores[own]
            if extra and len(core) and initials:
                initials += "".join(extra)
            return initials, core, "", [], ""
        tokens = [t for p in read for t, _ in p if t not in _TITLES]
        full = [t for t in tokens if len(t) > 1]
        singles = [t for t in tokens if len(t) == 1]
        givens = [t for t in full if self.given_of(t)]
        rest = [t for t in full if t not in givens]
        if not rest:
            rest, givens = full[-1:], full[:-1]
        elif not givens and len(rest) > 1:
            comma = len(read) > 1
            givens, rest = (rest[1:], rest[:1]) if comma else (rest[:1], rest[1:])
        possible = sorted({g for t in givens for g in (self.given_of(t) or {t})})
        first = "".join(sorted({i for g in possible for i in self.initials.get(g, {g[0]})})) if possible else "".join(singles[:1])
        middle = "".join(singles) if possible else "".join(singles[1:])
        return "person", rest or tokens or [x], first, possible, middle


def same_core(core: list[str], core2: list[str]) -> bool:
    """Whether two distinctive parts are alike: few edits and similar tokens, or the same letters."""
    one, two = "".join(core), "".join(core2)
    return one == two or (within(one, two, allowed_edits(one, two)) and monge_elkan(core, core2) >= SIMILAR)


def same_entity(a: tuple, b: tuple) -> bool:
    """Exact check of two parsed names: equal kind, similar distinctive part, compatible given names and initials."""
    kind, core, first, given, middle = a
    kind2, core2, first2, given2, middle2 = b
    if kind != kind2 or not same_core(core, core2):
        return False
    if kind == "person":
        if given and given2:
            if not set(given) & set(given2):
                return False
        elif first and first2 and not set(first) & set(first2):
            return False
        if middle and middle2 and middle != middle2:
            return False
    return True


_SEEDS = np.random.default_rng(20250101).integers(1, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


_LETTER_SEEDS = np.random.default_rng(20250102).integers(1, 1 << 62, LETTER_ROWS * LETTER_BANDS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _bands(grams: list[str], seeds: np.ndarray, bands: int) -> list[bytes]:
    g = np.array([xxhash.xxh3_64_intdigest(x) for x in grams], np.uint64)
    with np.errstate(over="ignore"):
        h = g[:, None] * seeds[None, :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return [x.tobytes() for x in h.min(axis=0).reshape(bands, -1)]


def band_keys(core: str) -> list[int]:
    """Keys by which a distinctive part meets others: what is left of it without some letters, or bands of its padded q-grams and of its letters where it is long.

    Bands are kept apart by length: parts of more than two letters' difference share none.
    """
    keys: list[int] = []
    if len(core) <= LISTED:
        keys += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in shortened(core)]
    if len(core) > LISTED - 2:  # two letters less than the shortest that has to meet by bands
        padded = "^" * (Q - 1) + core + "$" * (Q - 1)
        met: Counter = Counter()
        letters = []
        for c in core:
            met[c] += 1
            letters.append(f"{c}{met[c]}")
        bands = _bands([padded[i : i + Q] for i in range(len(padded) - Q + 1)], _SEEDS, BANDS) + _bands(letters, _LETTER_SEEDS, LETTER_BANDS)
        keys += [xxhash.xxh3_64_intdigest(b"%d %d " % (n, length) + k) - (1 << 63) for n, k in enumerate(bands) for length in range(len(core) - 2, len(core) + 1)]
    return keys


NODE = "node long, kind string, core array<string>, first string, given array<string>, middle string"


def parsed_names(names: DataFrame, nicknames: list[tuple[str, str]]) -> DataFrame:
    """(name, weight, node, parsed parts) of distinct names; spellings that parse alike share a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = NameParser(nicknames)
        for batch in batches:
            got = [parser.parse(n) for n in batch.column(0).to_pylist()]
            ids = [xxhash.xxh3_64_intdigest("\x1f".join([k, "".join(c), f, "|".join(g), m])) - (1 << 63) for k, c, f, g, m in got]
            columns = list(zip(*got)) or [[]] * 5
            kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["name", "weight", "node", "kind", "core", "first", "given", "middle"])

    return names.select("name", "weight").mapInArrow(run, f"name string, weight long, {NODE}")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cores = batch.column(0).to_pylist()
        keys = [band_keys(c) if len(c) >= SHORTEST - 1 else [] for c in cores]
        rows = np.repeat(np.arange(len(cores)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([x for k in keys for x in k], pa.int64())], ["core", "band"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = batch.to_pydict()
        ok = pa.array([same_core(x, y) for x, y in zip(p["tokens"], p["tokens2"])], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(ok) for c in ("core", "core2")], ["core", "core2"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = batch.to_pydict()
        left = zip(p["kind"], p["core"], p["first"], p["given"], p["middle"])
        right = zip(p["kind2"], p["core2"], p["first2"], p["given2"], p["middle2"])
        ok = [same_entity(x, y) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _merged(df: DataFrame) -> DataFrame:
    """The side of a join that is sorted, never broadcast: rows multiply in Python and in arrays, which the optimiser's sizes leave out, and a broadcast goes through the driver."""
    return df.hint("merge")


def similar_cores(nodes: DataFrame) -> DataFrame:
    """(core, core2) of all similar distinctive parts, each with itself and both ways.

    Every different part is one row, however many names hold it. Those that share a key
    are compared exactly.
    """
    cores = written(nodes.groupBy(F.concat_ws("", "core").alias("core")).agg(F.min("core").alias("tokens")), "cores")
    bands = cores.select("core").repartition(_tasks(nodes)).mapInArrow(_banded, "core string, band long").repartition("band")
    pairs = bands.join(_merged(bands.select("band", F.col("core").alias("core2"))), "band").where(F.col("core") < F.col("core2")).select("core", "core2").distinct()
    pairs = pairs.join(_merged(cores), "core").join(_merged(cores.select(F.col("core").alias("core2"), F.col("tokens").alias("tokens2"))), "core2")
    found = written(pairs.mapInArrow(_alike, "core string, core2 string"), "alike")
    return cores.select("core", F.col("core").alias("core2")).unionByName(found).unionByName(found.select(F.col("core2").alias("core"), F.col("core").alias("core2")))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """(a, b) of all pairs of nodes that are the same entity.

    Persons of one surname are not all compared: a node asks by its given names, one
    without by its initials, one without either by the surname alone, and only meets nodes
    that answer to that. Few spellings of a surname lack a given name, so the pairs grow
    with the names that are truly alike.
    """
    given, first = F.col("given"), F.filter(F.split("first", ""), lambda c: c != "")
    named = F.transform(given, lambda g: F.concat(F.lit("g"), g))
    initials = F.transform(first, lambda c: F.concat(F.lit("i"), c))
    one = F.array(F.lit(""))
    person = F.col("kind") == "person"
    asks = F.when(person & (F.size(given) > 0), named).when(person & (F.size(first) > 0), initials).otherwise(one)
    answers = F.when(person, F.concat(named, initials, one)).otherwise(one)
    parts = ("kind", "core", "first", "given", "middle")
    keyed = nodes.withColumn("whole", F.concat_ws("", "core"))
    asking = keyed.select(F.col("node").alias("a"), *parts, "whole", F.explode(F.array_distinct(asks)).alias("key"))
    near = similar_cores(nodes).select(F.col("core").alias("whole"), F.col("core2").alias("whole2"))
    answering = keyed.select(F.col("node").alias("b"), *[F.col(c).alias(c + "2") for c in parts], F.col("whole").alias("whole2"), F.explode(F.array_distinct(answers)).alias("key"))
    met = asking.join(_merged(near), "whole").join(_merged(answering), ["whole2", "key"]).where((F.col("a") != F.col("b")) & (F.col("kind") == F.col("kind2")))
    found = met.mapInArrow(_verified, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, centre): star clustering of the link graph.

    The heaviest node of its open neighbourhood becomes a centre and takes its open
    neighbours; repeated on what stays open. All rounds are joins and aggregations; each
    is written to the shared folder, so lineage stays short and executors may be lost.
    Every round closes the heaviest open node at least, and in practice a handful ends it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    open_nodes = written(nodes.select("node", "weight"), "open")
    both = written(both, "links")
    closed: DataFrame | None = None
    while True:
        rank = F.struct(F.col("weight").alias("w"), F.col("node").alias("n"))
        beside = both.join(_merged(open_nodes.select(F.col("node").alias("b"), rank.alias("r"))), "b").groupBy("a").agg(F.max("r").alias("top"))
        state = open_nodes.join(_merged(beside.withColumnRenamed("a", "node")), "node", "left").select("node", "weight", "top", rank.alias("r"))
        centres = state.where(F.col("top").isNull() | (F.col("r") > F.col("top"))).select("node", "weight")
        taken = both.join(_merged(centres.select(F.col("node").alias("b"), rank.alias("r"))), "b").groupBy("a").agg(F.max("r").getField("n").alias("centre")).withColumnRenamed("a", "node")
        done = written(centres.select("node", F.col("node").alias("centre")).unionByName(taken.join(_merged(open_nodes.select("node")), "node", "left_semi").select("node", "centre")).groupBy("node").agg(F.min("centre").alias("centre")), "stars")
        closed = done if closed is None else closed.unionByName(done)
        rest = written(open_nodes.join(_merged(done), "node", "left_anti"), "open")
        if rest.isEmpty():
            return closed
        open_nodes = rest


def link_names(df: DataFrame, name: str, nicknames: list[tuple[str, str]]) -> DataFrame:
    """(name, entity): every distinct stored spelling with the class of its entity.

    Distinct spellings are counted first, so a name that fills a third of all rows is one
    row from there on; spellings that parse alike become one node, and equal distinctive
    parts one row of the search. Parts that are equal without as many letters as edits are
    allowed are candidates (long ones by MinHash bands over padded q-grams), parsed parts
    are compared exactly, and star clustering forms the classes. Null and blank names are left out.
    """
    names = df.where(F.length(F.trim(F.col(name))) > 0).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    parsed = written(parsed_names(names.repartition(_tasks(df), "name"), nicknames), "names")
    nodes = parsed.groupBy("node").agg(F.sum("weight").alias("weight"), *[F.min(c).alias(c) for c in ("kind", "core", "first", "given", "middle")])
    nodes = written(nodes, "nodes")
    edges = written(linked_nodes(nodes), "edges")
    stars = star_clusters(nodes, edges)
    return parsed.select("name", "node").join(_merged(stars), "node").select("name", F.col("centre").alias("entity"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of one entity, the smaller in byte order first."""
    return linked.select("entity", F.col("name").alias("name_a")).join(_merged(linked.select("entity", F.col("name").alias("name_b"))), "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
