import numpy as np
import pandas as pd
import pytest

from lodestar.llm import langid
from lodestar.llm.sentences import sentence_spans

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def samples():
    return [tuple(r) for r in pd.read_parquet(f"{BIG}/lang_sample.parquet")[["lang", "text"]].itertuples(index=False)]


@pytest.fixture(scope="module")
def model(samples):
    return langid.calibrated(langid.fit_language_model(samples), [t for _, t in samples])


def test_probabilities_sum_to_at_most_one(model):
    # after any context the probabilities of all next characters leave room for unseen ones only
    tokens = ["a" + c for c in "abcdefghijklmnopqrstuvwxyz"]
    one, _ = model.token_costs(["a"])
    assert np.isfinite(one).all()
    costs, sizes = model.token_costs(tokens)
    assert (sizes == 3).all() and np.isfinite(costs).all() and (costs > 0).all()


def test_matches_a_plain_interpolated_model(samples):
    """The hash arrays give the probabilities of a dictionary model, in order three."""
    few = [s for s in samples if s[0] in ("en", "ms")][:20]
    m = langid.fit_language_model(few, order=3)
    from collections import Counter

    for j, lang in enumerate(m.languages):
        tokens = Counter(w for x, t in few if x == lang for w in langid.TOKEN.findall(t.lower()))
        full = [Counter(), Counter(), Counter()]
        for w, k in tokens.items():
            s = "\x02" + w + "\x03"
            for i in range(len(s)):
                for n in (1, 2, 3):
                    if i + 1 >= n:
                        full[n - 1][s[i + 1 - n : i + 1]] += k
        level = [Counter(g[1:] for g in full[1]), Counter(g[1:] for g in full[2]), full[2]]
        for n in (0, 1):
            level[n].update({g: k for g, k in full[n].items() if g[0] == "\x02"})

        def p(g):
            if g == "":
                return np.exp(m.floor)
            c = level[len(g) - 1]
            after = {h: k for h, k in c.items() if len(h) == len(g) and h[:-1] == g[:-1]}
            t = sum(after.values())
            low = p(g[1:])
            return low if not t else max(c.get(g, 0) - langid.DISCOUNT, 0) / t + langid.DISCOUNT * len(after) / t * low

        for word in ("and", "dan", "qz"):
            s = "\x02" + word + "\x03"
            want = -sum(np.log(p(s[max(0, i - 2) : i + 1])) for i in range(1, len(s)))
            got, _ = m.token_costs([word])
            assert got[0][j] == pytest.approx(want, rel=2e-3)


def test_held_out_accuracy(samples):
    train = [s for i, s in enumerate(samples) if i % 3]
    scorer = langid.Scorer(langid.fit_language_model(train))
    held = [s for i, s in enumerate(samples) if not i % 3]
    cost, _ = scorer.costs_of([t.lower() for _, t in held])
    right = np.mean([scorer.model.languages[i] == lang for i, (lang, _) in zip(cost.argmin(axis=1), held)])
    assert right >= 0.95


def test_labels():
    assert [langid.label_code(x) for x in ("en-GB", "English", " EN ", "zho", "zh-CN", "tl-PH", "xx", "", None, "und", "Malay")] == ["en", "en", "en", "zh", "zh", "tl", None, None, None, None, "ms"]


def test_segmentation_keeps_a_language_over_an_odd_sentence():
    costs = np.array([[1.0, 50], [1, 50], [6, 5], [1, 50], [90, 2], [90, 3]])
    assert langid.segment(costs).tolist() == [0, 0, 0, 0, 1, 1]


def test_operator(spark, model):
    rows = [
        ("a", "The pump is cheap. It lasts for many years of use.", "en-GB", "z"), ("b", "The pump is cheap. It lasts for years of use.", "th", "z"),
        ("c", "The design protects the users from damage and costs less. この装置は安定して動作することを確認した。交換は22か月に一度でよい！", "en", "z"),
        ("d", None, "en", "z"), ("e", " ", None, "z"), ("f", "123 45", "en", "z"), (None, "사용에 허가가 필요한가요?", "", "z"), ("g", "ผู้ใช้เปลี่ยนถังเพียงทุก 26 เดือนเท่านั้น " * 3000, "tha", "z"),
    ]
    df = spark.createDataFrame(rows, "id string, t string, l string, lang string")
    shared = spark.sparkContext.broadcast(model)
    got = sorted(((r["id"], r["seg_no"], r["lang"], r["right"], r["mixed"]) for r in langid.identify(df, "id", "t", "l", shared).collect()), key=str)
    assert got == sorted([("a", 1, "en", True, False), ("b", 1, "en", False, False), ("c", 1, "en", False, True), ("c", 2, "ja", False, True), (None, 1, "ko", False, False), ("g", 1, "th", True, False)], key=str)
    cases = {(r["id"], r["seg_no"]) for r in langid.identify(df, "id", "t", "l", shared, only_cases=True).collect()}
    assert cases == {("b", 1), ("c", 1), ("c", 2), (None, 1)}
    assert langid.identify(df.limit(0), "id", "t", "l", shared).count() == 0
    sure = langid.identify(df, "id", "t", "l", shared).agg({"confidence": "min"}).first()[0]
    assert 0 <= sure <= 1


def test_no_languages_no_rows(spark):
    empty = langid.calibrated(langid.fit_language_model([]), ["x"])
    df = spark.createDataFrame([("a", "The pump is cheap.")], "id string, t string")
    assert langid.identify(df, "id", "t", None, spark.sparkContext.broadcast(empty)).count() == 0


def test_whole_titles_and_columns_that_clash(spark, model):
    df = spark.createDataFrame([("a", "低コストな予定管理アプリとその装置", 1)], "lang string, t string, seg_no int").withColumnRenamed("lang", "rec")
    got = langid.identify(df, "rec", "t", None, spark.sparkContext.broadcast(model), whole=True).collect()
    assert [(r["rec"], r["seg_no"], r["lang"]) for r in got] == [("a", 1, "ja")]


def test_labelled_documents_agree(model):
    docs = pd.read_parquet(f"{BIG}/documents.parquet", columns=["text", "lang"]).head(1500)
    scorer = langid.Scorer(model)
    right = total = 0
    for text, label in zip(docs.text, docs.lang):
        code = langid.label_code(label)
        units = [text[a:b].lower() for a, b in sentence_spans(text)]
        if code and units:
            cost, _ = scorer.costs_of(units)
            right += model.languages[int(cost.sum(axis=0).argmin())] == code
            total += 1
    assert right / total > 0.9  # some labels are wrong


FOREIGN = [
    "La pompe économise l'eau pendant la saison sèche et coûte environ vingt pour cent de moins.", "Die Pumpe spart Wasser in der Trockenzeit und kostet etwa zwanzig Prozent weniger als andere.", "La bomba ahorra agua en la temporada seca y cuesta un veinte por ciento menos.",
    "Насос экономит воду в сухой сезон и стоит на двадцать процентов меньше.", "Pompa oszczędza wodę w porze suchej i kosztuje o dwadzieścia procent mniej.", "Η αντλία εξοικονομεί νερό την ξηρή περίοδο.", "Pumppu säästää vettä kuivana kautena ja maksaa noin kaksikymmentä prosenttia vähemmän.",
]


def test_segments_in_no_known_language_are_rejected(spark, data):
    from lodestar.llm.queries import language_model

    model = language_model(spark, "/root/testdata/sf0.01")
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"]).text.dropna().sample(400, random_state=7).tolist()
    df = spark.createDataFrame([(f"f{i}", t, "en") for i, t in enumerate(FOREIGN)] + [(f"d{i}", t, "en") for i, t in enumerate(docs)], "k string, t string, label string")
    got = langid.identify(df, "k", "t", "label", model, closest=False).collect()
    assert all(r["lang"] is None and r["confidence"] == 0 for r in got if r["k"][0] == "f") and len({r["k"] for r in got if r["k"][0] == "f"}) == len(FOREIGN)
    known = [r for r in got if r["k"][0] == "d"]
    assert sum(r["lang"] is None for r in known) <= 0.02 * len(known)
    assert all(r["lang"] for r in langid.identify(df, "k", "t", "label", model).collect())
