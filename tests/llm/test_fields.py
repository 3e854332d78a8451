import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.llm import residue
from lodestar.llm.residue import is_message, template_residue
from lodestar.llm.truncation import truncated, truncation_rates

REAL = ["The pump saves water in the dry season and costs about {0} percent less.", "Field tests with rice husk showed that unit {0} raises yield per hectare.", "Users report that drum {0} holds colour after fifty washes."]


@pytest.mark.parametrize("value, told", [
    ("404 - The page you asked for was not found on this server.", True), ("<p>Please enable JavaScript in your browser to view this offer.</p>", True), ("Notice: Too many requests. Slow down.", True),
    ("!! null", True), ("undefined - undefined", True), ("asdf asdf asdf", True), ("Lorem ipsum dolor amet velit nunc", True), ("ไม่พบหน้าที่ต้องการ", True), ("요청하신 페이지를 찾을 수 없습니다.", True), ("请启用脚本后刷新页面。", True), ("Harbour - Page not found", True),
    ("It checks that pages stay readable when JavaScript is disabled.", False), ("A placeholder electrode keeps the cavity open.", False), ("An error page editor is part of the bundle.", False), ("Ion exchange resin", False), ("Cookies and snack bars were chosen as test food.", False), ("Test strip for blood", False), ("", False),
])
def test_messages(value, told):
    assert is_message(value) is told


SCHEMA = "id string, title string, summary string, source_id string, source_name string"


def residues(spark, rows):
    df = spark.createDataFrame([(str(i), t, s, f"s{i % 4}", None) for i, (t, s) in enumerate(rows)], SCHEMA)
    return {(int(r["id"]), r["field"]) for r in template_residue(df, "id", ["title", "summary"], "source_id").collect()}


@pytest.mark.parametrize("slot", ["{{ title }}", "{{{org}}}", "{% trl %}", "${title}", "#{x}", "%{x}", "$!date_posted", "<%= org %>", "<<org>>", "<!-- org -->", "&lt;org&gt;", "@@org@@", "%%org%%", "%TITLE%", "__TITLE__", "XXorgXX", "[[org]]", "[TBD: org]", "[your org]", "[insert trl here]", "(add partner_name)", "*** org TO FOLLOW ***", "TITLE_PLACEHOLDER", "<title goes here>", "[object Object]", "#NAME?", "%s - Pump", "{title}"])
def test_slots_alone_and_inside_text(spark, slot):
    rows = [(slot, None), ("Pump", f"The pump {slot} saves water every day."), ("Pump", f"It saves water. {slot}")]
    assert residues(spark, rows) == {(0, "title"), (1, "summary"), (2, "summary")}


def test_marks_that_a_template_writes_about_are_no_slots(spark):
    rows = [("Pump", f"No {i} differs. It replaces marks written {{name}} in letter forms. End {i}.") for i in range(5)]
    assert residues(spark, rows) == set()
    assert residues(spark, [("Pump", "It fills marks such as {name} in letters.")]) == set()
    assert residues(spark, [("Pump", "The set [A, B, C] of moulds; p < 0.06 holds; 5 % less.")]) == set()


def test_one_slot_left_in_many_records_of_a_template(spark):
    rows = [("Pump", f"No {i} differs. The pump of {{org}} saves water. End {i}.") for i in range(5)]
    rows += [("Pump", f"It fills marks written {{{{org}}}} in letters of {{{{org}}}} no {i}.") for i in range(5)]
    assert residues(spark, rows) == {(i, "summary") for i in range(10)}
    once = "No 9 differs. It fills marks written {name} in forms and leaves {org} here."
    assert residues(spark, [("Pump", once)] * 2) == {(0, "summary"), (1, "summary")}


def test_copies_of_one_text_are_one_alignment(spark):
    rows = [("Pump", "The pump {org} saves water every day.")] * 6
    assert residues(spark, rows) == {(i, "summary") for i in range(6)}


def test_unknown_page_template_is_induced(spark):
    rows = [("Pump", "Wrong turn 12, friend.")] * 16 + [(f"Pump {i}", REAL[i % 3].format(i) + f" Extra {chr(97 + i % 26)}{chr(97 + i // 26)}.") for i in range(60)] + [("Pump", REAL[0].format(7))] * 16
    got = residues(spark, rows)
    assert {(i, "summary") for i in range(16)} <= got and not any(i >= 16 and f == "summary" for i, f in got)


UNSEEN_SLOTS = [":title:", "~~org_name~~", "|*FNAME*|", "^trl^", "«Title»", "<?= name ?>", "[[org]]", "{{ partner.name }}"]
UNSEEN_PAGES = [
    "Diese Seite wurde leider verschoben.", "Bitte melden Sie sich an, um fortzufahren.", "La page demandée n'existe plus.", "Votre session a expiré, reconnectez-vous.", "Esta oferta ya no está publicada.", "Active las secuencias de comandos del navegador.",
    "Hold tight while we fetch your listing.", "Nothing to show under this address", "Our robots are resting right now.", "ขออภัย ระบบปิดปรับปรุงชั่วคราว", "申し訳ございません、掲載は終了しました。", "이 게시물은 삭제되었습니다.",
]


@pytest.fixture(scope="module")
def real():
    t = pd.read_parquet("/root/testdata/sf0.01/technology.parquet", columns=["title", "summary"]).dropna().drop_duplicates("summary")
    return [(a, b) for a, b in zip(t.title, t.summary) if len(b) > 80][:600]


@pytest.mark.parametrize("copies", [1, 10])
def test_slots_and_pages_are_induced_without_any_list(spark, real, copies):
    rows = [(f"r{i}", a, b, f"s{i % 7}") for i, (a, b) in enumerate(real)]
    rows += [(f"m{k}-{i}", "Pump", f"The offer of {mark} was filed in 20{i % 30:02d} with {REAL[i % 3].format(i)}", f"s{i % 4}") for k, mark in enumerate(UNSEEN_SLOTS) for i in range(16)]
    rows += [(f"p{k}-{i}", "Pump", page, f"s{i % 4}") for k, page in enumerate(UNSEEN_PAGES) for i in range(16)]
    df = spark.createDataFrame([(f"{i}/{c}", t, v, s, None) for i, t, v, s in rows for c in range(copies)], SCHEMA)
    got = {r["id"].split("/")[0] for r in template_residue(df, "id", ["summary"], "source_id", known=False).collect()}
    planted = {i for i, *_ in rows if i[0] in "mp"}
    assert len(got & planted) >= 0.95 * len(planted)
    every = {f"r{i}" for i, r in enumerate(real) if residue.is_message(r[1]) or re.search(residue.SLOT, r[1])}
    assert len({g for g in got - planted if g not in every}) <= 2


def test_residue_on_awkward_rows(spark):
    df = spark.createDataFrame([(None, "{org}", "y", None, None), ("1", None, "", None, None), ("2", "{org}", "long " * 50000, None, None), ("2", "{org}", "long " * 50000, None, None)], SCHEMA).withColumn("field", F.lit(1)).withColumn("value", F.lit(2))
    assert [(r["id"], r["field"]) for r in template_residue(df, "id", ["title", "summary"], "source_id").collect()] == [("2", "title")]
    assert template_residue(df.limit(0), "id", ["title", "summary"], "source_id").count() == 0


def cut_ids(spark, rows):
    df = spark.createDataFrame(rows, "id string, summary string, source_id string").withColumn("source", F.lit("clash"))
    found = truncated(df, "id", "summary", "source_id")
    return {r["id"] for r in found.where("truncated").collect()}, found


def test_truncation_signs(spark):
    whole = [(f"w{i}", " ".join(r.format(i % 90) for r in REAL), f"s{i % 3}") for i in range(120)]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(REAL).format(rng.randrange(90)) for _ in range(6)) for i in range(400)]
    spike = [(f"k{i}", t[:151], "spiky") for i, t in enumerate([t for t in texts if t[147:151].isalpha() and t[151].isalpha()][:40])]
    marked = [("m1", REAL[0].format(3)[:-9] + "…", "a"), ("m2", REAL[1].format(4)[:30] + " [more]", "a"), ("m3", REAL[1].format(4)[:40] + "&nbs", "a"), ("m4", "เทคโนโลยี�", "a"), ("m5", REAL[1].format(5) + " Read more", "a")]
    loose = [("l1", REAL[0].format(3) + " " + REAL[1].format(4)[:37], "b"), ("ok1", REAL[2].format(5)[:-1], "b"), ("ok2", REAL[2].format(6) + " {title}", "b"), ("ok3", "404 Not Found", "b")]
    decoy = [(f"d{i}", REAL[i % 3].format(i) + " The list of uses grows each year...", "c") for i in range(12)]
    got, found = cut_ids(spark, whole + spike + marked + loose + decoy)
    assert got == {r[0] for r in spike} | {"m1", "m2", "m3", "m4", "m5", "l1"} and len(spike) > 20
    rates = {r["source"]: (r["n_records"], r["n_truncated"]) for r in truncation_rates(found).collect()}
    assert rates["spiky"] == (len(spike), len(spike)) and rates["c"] == (12, 0)


def test_truncation_on_awkward_rows(spark):
    rows = [("1", None, "a"), ("2", "", "a"), ("3", "  ", None), ("4", "Good. " * 30000, None), ("4", "Good. " * 30000, None), (None, "Fine.", "a")]
    got, found = cut_ids(spark, rows)
    assert got == set() and found.count() == 2
    none = spark.createDataFrame([], "id string, summary string, source_id string")
    assert truncated(none, "id", "summary", "source_id").count() == 0


def test_copies_of_a_table_are_judged_like_the_table(spark, real):
    rows = [(f"w{i}", b, f"s{i % 5}") for i, (_, b) in enumerate(real)] + [(f"c{i}", b[: 40 + 3 * (i % 30)], f"s{i % 5}") for i, (_, b) in enumerate(real[:150])] + [(f"k{i}", b[:90], "spiky") for i, (_, b) in enumerate(real[150:250])]
    once = cut_ids(spark, rows)[0]
    often = cut_ids(spark, [(f"{i}/{n}", b, s) for i, b, s in rows for n in range(10)])[0]
    assert {i.split("/")[0] for i in often} == once and len({i for i in once if i[0] in "ck"}) > 200
