import itertools
import random

import pandas as pd
import pytest

from lodestar.llm import names

NICKS = [("Robert", "Bob"), ("Robert", "Rob"), ("Katherine", "Kate"), ("Muhammad", "Md"), ("Josephine", "Jo")]
SAME = [
    {"Pesfin Tekmen Agricultural University", "pesfin tekmen agri. univ.", "Agricultural University, Pesfin Tekmen", "AU (Pesfin Tekmen)", "The Pesfin Tkmen AU, Ketara", "Pesfin-Tekmen Agricutural University.", "PesfinTekmen AU"},
    {"Pesfin Tekmen Polytechnic College", "Poly. Coll. (Pesfin Tekmen)", "PESFIN  TEKMEN PC"},
    {"Vursak Birnas Medical Devices Sdn. Bhd.", "Med. Devices SB, Vursak Birnas", "Vursak Biras MDSB"},
    {"Robert Kamgardusbak", "Bob Kamgardusbak", "KAMGARDUSBAK, ROB", "Dr. Robert K. Kamgardusbak", "R. K. Kamgardusbak", "Kamgardusbak Robért", "B. K. Kamgardusbak"},
    {"Katherine Kamgardusbak", "Mr Kate Kamgardusbak"},
    {"Md Dorsakpilmen", "Muhammad Dorsakpilmen", "Muhamad Dorsakpilmen"},
]


def test_parsed_forms_agree_within_and_differ_between():
    parser = names.NameParser(NICKS)
    for a, b in itertools.combinations(range(len(SAME)), 2):
        for x in SAME[a]:
            for y in SAME[b]:
                if "K. Kamgardusbak" not in x + y:
                    assert not names.same_entity(parser.parse(x), parser.parse(y)), (x, y)


def test_linked_spellings(spark):
    rows = [(n, i) for s in SAME for i, n in enumerate(sorted(s)) for _ in range(9 if i == 0 or "Robert Kam" in n else 1)] + [(None, 0), ("", 0), ("  ", 0), ("???", 1), ("x" * 50000, 1)]
    df = spark.createDataFrame(rows, "org_name string, weight int").withColumnRenamed("weight", "node")
    linked = names.link_names(df, "org_name", NICKS).collect()
    assert len(linked) == len({r["name"] for r in linked}) == len({r[0] for r in rows if r[0] and r[0].strip()})
    entity = {r["name"]: r["entity"] for r in linked}
    for s in SAME:
        assert len({entity[n] for n in s}) == 1, s
    assert len({entity[n] for s in SAME for n in s}) == len(SAME)
    pairs = {tuple(r) for r in names.spelling_pairs(names.link_names(df, "org_name", NICKS)).collect()}
    assert pairs == {tuple(sorted(p, key=lambda n: n.encode())) for s in SAME for p in itertools.combinations(s, 2)}
    assert names.link_names(df.limit(0), "org_name", NICKS).count() == 0


def test_recall_of_bands_follows_the_curve():
    assert names.collision_curve(0.5) > 0.99 and names.collision_curve(0.1) < 0.05
    parser = names.NameParser(NICKS)
    stored = sorted(set(pd.read_parquet("/root/testdata/sf0.1/technology.parquet", columns=["org_name"]).org_name.dropna()))[:500]
    parsed = [parser.parse(n) for n in stored if n.strip()]
    keys = [set(names.band_keys("".join(p[1]))) for p in parsed]
    found = total = 0
    for i, j in itertools.combinations(range(len(parsed)), 2):
        if parsed[i][0] == parsed[j][0] and names.same_entity(parsed[i], parsed[j]):
            total += 1
            found += bool(keys[i] & keys[j])
    assert total > 50 and found / total >= 0.97


def test_star_clusters_against_brute_force(spark):
    weights = {1: 5, 2: 9, 3: 1, 4: 7, 5: 2, 6: 2}
    edges = [(1, 2), (2, 3), (3, 4), (5, 6)]
    nodes = spark.createDataFrame(list(weights.items()), "node long, weight long")
    got = {r["node"]: r["centre"] for r in names.star_clusters(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in weights}
    want, left = {}, set(weights)
    for n in sorted(weights, key=lambda n: (-weights[n], -n)):
        if n in left:
            for m in {n} | (near[n] & left):
                want[m] = n
            left -= {n} | near[n]
    assert got == want


@pytest.mark.parametrize("a, b, most, ok", [("tekmen", "tkemen", 1, True), ("tekmen", "tekmn", 1, True), ("tekmen", "takmon", 1, False), ("", "a", 1, True), ("abc", "abc", 0, True), ("abcd", "wxyz", 2, False)])
def test_edit_distance(a, b, most, ok):
    assert names.within(a, b, most) is ok


def _edited(rng, word, kinds):
    for kind in kinds:
        i = rng.randrange(len(word) - 1)
        c = rng.choice("abcdefghijklmnopqrstuvwxyz")
        word = {"swap": word[:i] + word[i + 1] + word[i] + word[i + 2 :], "put": word[:i] + c + word[i + 1 :], "add": word[:i] + c + word[i:], "drop": word[:i] + word[i + 1 :]}[kind]
    return word


@pytest.mark.parametrize("length, kinds", [(n, (k,)) for n in (6, 7, 10) for k in ("swap", "put", "add", "drop")] + [(n, k) for n in (11, 13, 16) for k in itertools.combinations_with_replacement(("swap", "put", "add", "drop"), 2) if n > 11 or "drop" not in k])
def test_accepted_pairs_meet_in_every_class_of_edits(length, kinds):
    rng = random.Random(f"{length}{kinds}")
    met = total = 0
    for _ in range(400):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        other = _edited(rng, word, kinds)
        if names.same_core([word], [other]) and word != other:
            total += 1
            met += bool(set(names.band_keys(word)) & set(names.band_keys(other)))
    assert total > 200 and met / total >= 0.95, (met, total)


def test_common_surnames_are_not_compared_all_with_all(spark, monkeypatch):
    parser = names.NameParser(NICKS)
    rng = random.Random(2)
    given = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)]
    stored = [f"{g} Kamgardusbak" for g in given] + [f"{g[0]}. Kamgardusbak" for g in given] + [f"{given[0]} Kamgardusbk"]
    parsed = {n: parser.parse(n) for n in set(stored)}
    rows = [(i, *parsed[n]) for i, n in enumerate(sorted(parsed))]
    nodes = spark.createDataFrame([(i, 1, k, c, f, g, m) for i, k, c, f, g, m in rows], "node long, weight long, kind string, core array<string>, first string, given array<string>, middle string")
    got = {tuple(r) for r in names.linked_nodes(nodes).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if names.same_entity(a[1:], b[1:])}
    assert got == want and len(want) > 100


def test_no_join_over_names_goes_through_the_driver(spark, monkeypatch):
    plans = []

    def recorded(df, label):
        plans.append((label, df))
        return stored(df, label)

    stored = names.written
    monkeypatch.setattr(names, "written", recorded)
    df = spark.createDataFrame([(n,) for s in SAME for n in s], "org_name string")
    pairs = names.spelling_pairs(names.link_names(df, "org_name", NICKS))
    assert pairs.count() > 20
    plans.append(("pairs", pairs))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    for label, df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), label
    assert sum("Join" in df._jdf.queryExecution().executedPlan().toString() for _, df in plans) >= 4


@pytest.mark.parametrize("length", (5, 9, 10, 11, 12, 13, 16, 22, 24))
def test_no_accepted_pair_is_missed_and_unlike_parts_do_not_meet(length):
    rng = random.Random(length)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice("bdfgklmnprstvz")
    words = ["".join(syllable() for _ in range(length // 3 + 1))[:length] for _ in range(300)]
    for word in words:
        other = _edited(rng, word, rng.choices(("swap", "put", "add", "drop"), k=2 if length >= 11 else 1))
        if names.within(word, other, names.allowed_edits(word, other)):
            assert set(names.band_keys(word)) & set(names.band_keys(other)), (word, other)
    if 11 <= length <= 22:
        keys = [set(names.band_keys(w)) for w in words]
        met = [(a, b) for a, b in itertools.combinations(range(len(words)), 2) if keys[a] & keys[b]]
        assert len(met) <= 5, len(met)


@pytest.mark.parametrize("length", (25, 26, 30))
def test_long_parts_meet_by_bands_of_like_length(length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for w in [word(length) for _ in range(100)]:
        for other in (w[2:], w[:10] + w[11:], w + "ab", w[1] + w[0] + w[2:-2] + w[-1] + w[-2]):
            assert set(names.band_keys(w)) & set(names.band_keys(other)), (w, other)
        assert not set(names.band_keys(w)) & set(names.band_keys(w + "abc"))
