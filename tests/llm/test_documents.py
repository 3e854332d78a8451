import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.llm import leakage, mixing, subjects

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    t = pd.read_parquet(f"{BIG}/technology.parquet", columns=["id", "title", "summary", "sector_codes"]).drop_duplicates("id")
    t = t[t.summary.fillna("").str.len() > 60]
    return [((a or "") + ". " + b, list(c)) for a, b, c in zip(t.title, t.summary, t.sector_codes) if c is not None and len(c)]


def test_subjects_on_held_out_records(labelled):
    codes = {c for _, cs in labelled for c in cs}
    half = len(labelled) * 2 // 3
    automaton = subjects.curate_terms(labelled[:half], codes).automaton()
    hit = total = 0
    for text, cs in labelled[half:]:
        found = {s for s, _ in subjects.treated_subjects(text, automaton)}
        if found:
            hit += bool(found & set(cs))
            total += 1
    assert total > 0.95 * (len(labelled) - half) and hit / total > 0.82  # a tenth of the stored codes are wrong


def test_threshold_of_sentences_is_the_calibrated_one(labelled):
    codes = {c for _, cs in labelled for c in cs}
    half = len(labelled) * 2 // 3
    curve = subjects.calibrated_sentence(labelled[half:], subjects.curate_terms(labelled[:half], codes).automaton())
    assert subjects.SENTENCE in curve and curve[subjects.SENTENCE] >= max(curve.values()) - 0.004 and curve[3.0] < curve[subjects.SENTENCE]


def test_subjects_of_awkward_rows(spark, labelled):
    terms = subjects.curate_terms(labelled[:1500], {c for _, cs in labelled for c in cs})
    shared = spark.sparkContext.broadcast(terms)
    sample = labelled[3][0]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "qq ww", "x"), (4, sample * 500, "x"), (5, sample, "x"), (5, sample, "x")], "k long, t string, subject string")
    got = subjects.assign_subjects(df, "k", "t", shared).collect()
    assert {r["k"] for r in got} == {4, 5} and len([r for r in got if r["k"] == 5]) % 2 == 0
    assert subjects.assign_subjects(df, "k", "t", spark.sparkContext.broadcast(subjects.curate_terms([], set()))).count() == 0


def test_term_needs_a_subject_of_its_own():
    rows = [("solar pump works", ["27"])] * 9 + [("steel pump works", ["77"])] * 9
    kept = subjects.curate_terms(rows, {"27", "77"}).weights
    assert kept["solar"][0] == "27" and kept["steel"][0] == "77" and "pump" not in kept


def test_terms_inside_inflected_longer_terms_count():
    automaton = subjects.SubjectTerms({"solar": ("27", 2.0), "panel": ("91", 2.0), "solar panel": ("27", 3.0), "energy": ("29", 1.0)}).automaton()
    found = lambda text: subjects._whole_terms(text, automaton)
    assert found("the solar panels here") == [(4, "27", 2.0)] and found("the solar panel here") == [(4, "27", 3.0)]
    assert found("bioenergy, solar panelling and solar panel") == [(11, "27", 2.0), (31, "27", 3.0)]
    assert subjects.treated_subjects("The solar panels here.", automaton) == [("27", 1.0)]


def test_every_subject_over_its_threshold_is_assigned():
    automaton = subjects.SubjectTerms({"solar": ("27", 2.0), "steel": ("77", 2.0), "yarn": ("59", 2.0), "kiln": ("81", 1.0)}).automaton()
    found = lambda text: [s for s, _ in subjects.treated_subjects(text, automaton)]
    assert found("A solar one. A steel one. A yarn one.") == ["27", "59", "77"]
    assert found("A solar steel frame holds yarn.") == ["27", "59", "77"] and found("A kiln and solar.") == ["27"]
    assert subjects.treated_subjects("Solar. Solar steel.", automaton) == [("27", 0.666667), ("77", 0.333333)]


@pytest.fixture(scope="module")
def items():
    return [tuple(r) for r in pd.read_parquet(f"{BIG}/eval_item.parquet")[["item_id", "text"]].itertuples(index=False)]


def test_blocks_find_every_fingerprint_within_the_radius(items):
    import numpy as np

    index = leakage.index_items(items)
    rng = np.random.default_rng(1)
    picked = rng.choice(len(index.prints), 300)
    asked = index.prints[picked].copy()
    for i in range(len(asked)):
        for b in rng.choice(64, leakage.RADIUS, replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(b)
    at, who = index.candidates(asked)
    found = set(zip(at.tolist(), who.tolist()))
    every = {(i, int(index.owner[j])) for i in range(len(asked)) for j in np.flatnonzero(np.bitwise_count(index.prints ^ asked[i]) <= leakage.RADIUS)}
    assert found == every and all((i, int(index.owner[p])) in found for i, p in enumerate(picked))


def test_planted_passages(spark, items):
    rng = random.Random(3)
    rows, expected = [], set()
    filler = "The design protects wire rod from damage and lowers the reject rate in most provinces. "
    for n, (i, text) in enumerate(items):
        words = text.split() if " " in text.strip() and not re.search("[ก-๛ぁ-ん]", text) else list(text)
        joint = " " if words != list(text) else ""
        k = len(words)
        kinds = {
            0: joint.join(words), 1: joint.join(words[: int(k * 0.7)]).upper(), 2: joint.join(words[int(k * 0.35) :]),
            3: joint.join(w if j % 17 or not joint else "changed" for j, w in enumerate(words)).replace("a", "а"), 4: joint.join(words[: int(k * 0.3)]),
            5: joint.join(words[: int(k * 0.35)]) + " " + filler + joint.join(words[int(k * 0.6) :]),
        }
        rows.append((n, filler * 3 + kinds[n % 6] + " " + filler, 0))
        if n % 6 != 4:
            expected.add((n, i))
        rng.random()
    df = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0), (902, filler * 3000, 0)], "k long, t string, share int")
    index = spark.sparkContext.broadcast(leakage.index_items(items))
    got = {(r["k"], r["item_id"]) for r in leakage.leaked_items(df, "k", "t", index).collect()}
    assert len(expected - got) <= 1 and not {g for g in got - expected}
    assert leakage.leaked_items(df, "k", "t", spark.sparkContext.broadcast(leakage.index_items([]))).count() == 0


def test_search_finds_all_that_the_exact_check_accepts(spark, items):
    rng = random.Random(5)
    rows = []
    for n, (_, text) in enumerate(items):
        units = leakage.folded_units(text)
        every = 4 + n % 5
        mixed = [f"w{rng.randrange(9999)}" if j % every == every - 1 else u for j, u in enumerate(units)]
        pieces = [u for j in range(0, len(units), 8) for u in [*units[j : j + 6 + n % 2], "aside", "aside"]]
        rows += [(2 * n, " ".join(mixed[: int(len(units) * (0.6 + 0.1 * (n % 5)))])), (2 * n + 1, " ".join(pieces))]
    index = leakage.index_items(items)
    want = {(k, index.ids[m]) for k, t in rows for m in range(len(index.ids)) if leakage.held_share(leakage.folded_units(t), index.units[m], index.weights[m]) >= leakage.HELD}
    got = leakage.leaked_items(spark.createDataFrame(rows, "k long, t string"), "k", "t", spark.sparkContext.broadcast(index)).collect()
    assert {(r["k"], r["item_id"]) for r in got} == want and len(got) == len(want) > 100


def test_apportionment_is_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], [99, 99, 99], 7) == [3, 2, 2]
    assert mixing.sainte_lague([0.5, 0.5], [1, 99], 6) == [1, 5] and mixing.sainte_lague([0, 1], [5, 5], 3) == [0, 3] and mixing.sainte_lague([], [], 3) == []


def test_tokenizer_round_trip():
    enc = mixing.encoding()
    for text in ("Plain words 12.5, ok?", "ไทย 日本語 한국어 हिन्दी", " <|endoftext|> \n\n x"):
        assert enc.decode(enc.encode_ordinary(text)) == text


def test_mixture(spark):
    rows = [(i, f"word{i % 7} " * (20 + i % 50), "big") for i in range(900)] + [(1000 + i, "small text here " * (10 + i % 9), "small") for i in range(60)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", None), (2003, "other", "else"), (5, "word5 " * 25, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, "doc_id", "text", "source", targets)
    shares = {r["source"]: r for r in mix.shares.collect()}
    assert abs(shares["big"]["actual_share"] - 0.6) < 0.02 and abs(shares["small"]["actual_share"] - 0.4) < 0.02
    chosen = mix.selection.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and {r["source"] for r in chosen} == {"big", "small"}
    assert max(r["copies"] for r in chosen if r["source"] == "big") == 1 and max(r["copies"] for r in chosen if r["source"] == "small") <= 3
    assert sum(r["tokens"] * r["copies"] for r in chosen) == sum(r["tokens"] for r in shares.values())
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, mixing.mix_sources(df, "doc_id", "text", "source", targets).selection.collect()))
    assert mixing.mix_sources(df.limit(0), "doc_id", "text", "source", targets).selection.count() == 0


def test_mixture_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 150)
    df = spark.createDataFrame([(i, "some words here " * (5 + i % 40), "big" if i % 4 else "small") for i in range(2400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, "doc_id", "text", "source", targets)
    shares = {r["source"]: r["actual_share"] for r in mix.shares.collect()}
    assert abs(shares["big"] - 0.5) < 0.01 and mix.selection.agg({"copies": "max"}).first()[0] == 2
