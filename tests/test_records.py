"""Records, corrections, evaluation and layout by micro rows."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import records
from quern.operators import correction, evaluation, layout


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (records.merged_tens, "10 6 and 3{ú}", "16 and 30"), (records.record_source, "1diš gin2 dumu a- na", "1 GÍN DUMU a-na"), (records.record_source, "dumu-ni", "dumu-ni"),
        (records.record_target, "S,illi (?) took (it) lit. seized; end..", "Ṣilli took it; end."), (records.ascii_record, "sza _lugal_ t,up", "ša LUGAL ṭup"), (records.capital_spans, "a_b", "a_b"),
        (records.line_body, "12'. a-na", "a-na"), (records.base_id, "0123abcd-x", "x"), (records.variety, "Old Assyrian (ca. 1950)", "OA"), (records.variety, None, "other"),
        (records.language, "akk;sux", "Akkadian-Sumerian"), (records.roman_months, "month VIII day 2", "month 8 day 2"), (records.boilerplate, " ... ", True),
        (records.artifact_ids, '<a href="/artifacts/2001"> P001500 <a href="/artifacts/9">', [1500, 2001]),
    ],
)
def test_rules(spark, fn, given, wanted):
    assert one(spark, given, fn) == wanted


def test_scalar_rules():
    assert records.snapped("0.33333 10.5 1.1 2.0") == "⅓ 10 ½ 1.1 2"
    assert records.tidy_braces("{d}a {long token here}b {x{y}z} c} {TOOLONGTOKEN}") == "{d}a b c"
    text = "1 first\n2 second\nno number\n3 third"
    assert records.numbered_lines(text) == "first\nsecond\nno number\nthird"
    assert records.numbered_lines("1 first\n5 sheep") == "1 first\n5 sheep"
    assert records.answer_of("thinking\nTranslation: To him.") == "To him." and records.answer_of("") == "" and records.answer_of("a\nThe last line.") == "The last line."


def test_artifact(spark):
    x = json.dumps({"id": "7", "genres": [{"genre": {"genre": "Letter"}}, {"genre": {"genre": "Legal"}}], "period": {"period": "OA"}, "inscription": {"atf": "1. a"}})
    r = one(spark, x, records.artifact)
    assert (r["id"], r["genres"], r["period"], r["atf"]) == ("7", "Letter; Legal", "OA", "1. a")


def test_line_range(spark):
    d = spark.createDataFrame([("10-12",), ("2",), ("x",)], "r string")
    assert [r["r"] for r in d.orderBy(records.line_range(F.col("r"))).collect()] == ["2", "10-12", "x"]


def test_correction(spark):
    assert one(spark, "me-+e„er mup-pu aa", correction.repaired) == "me-he-er ṭup-pu ša"
    assert one(spark, "clean", correction.repaired) == "clean"
    texts = spark.createDataFrame([("ša-mu ša-mu, be-lu 12",)], "t string")
    lex = spark.createDataFrame([("ṭup-pu",), ("be-lu",)], "form string")
    v = correction.vocabulary(texts, "t", lex, "form")
    assert {tuple(r) for r in v.collect()} == {("ša-mu", 2), ("be-lu", 1), ("ṭup-pu", 1)}
    d = spark.createDataFrame([(1, "aa-mu be-lw (x) 12"), (2, "")], "id long, t string")
    got = {r["id"]: r for r in correction.corrected(d, "id", "t", v).collect()}
    assert got[1]["t"] == "ša-mu be-lu (x) 12" and [c["method"] for c in got[1]["corrections"]] == ["swap", "edit_distance"] and got[2]["t"] == ""


def test_marks(spark):
    assert correction.with_marks("the kings house is", "the king's house was") == "the king's house is"
    assert correction.fuzzy_names("To Asur-idi now", ["Assur-idi"]) == "To Assur-idi now" and correction.fuzzy_names("Xyz", ["Xyzz"], 1.0) == "Xyz"
    assert one(spark, "a / b 1 / 2 x/y", lambda c: correction.slash_alternatives(c, [("x/y", "x")])).split() == ["a", "b", "1/2", "x"]


def test_marks_of_whole_texts(spark, sf):
    """Every document has a row, long ones and nulls too."""
    import re

    from quern.plans.registry import QUERIES

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        now, old = (x if x is None else x.strip(" ") for x in (r["text"], r["text"] and re.sub("(?<=e)s ", "'s ", r["text"])))
        want[r["doc_id"]] = now if not old or "'" not in old or now == old else " ".join(old.split())
    assert max(len(x or "") for x in want.values()) > 2000
    assert {r["doc_id"]: r["text"] for r in QUERIES["restored_marks"](spark, sf).collect()} == want
    long = "the kings house is here " * 3000
    assert correction.with_marks(long, long.replace("kings", "king's")) == long.replace("kings", "king's").strip()


def test_errors(spark):
    d = spark.createDataFrame([(1, "one two three one two three", "5 sheep [[E01]] of Puzur"), (2, "5 sheep [[E01]] of Puzur", "5 sheep [[E01]] of Puzur"), (3, None, None)], "id long, p string, r string")
    f = {r["id"]: r for r in evaluation.error_flags(d, "p", "r", ["Puzur"]).collect()}
    assert all(f[1][c] for c in ("err_proper_noun", "err_number", "err_repeated", "err_tag")) and not any(f[2][c] for c in f[2].asDict() if c.startswith("err_"))
    s = {r["error"]: (r["n"], r["first"]) for r in evaluation.error_summary(evaluation.error_flags(d, "p", "r"), "id").collect()}
    assert s["number"] == (1, 1) and s["truncated"] == (0, None)
    r = evaluation.rates(d.where("id = 2"), "p", "r", "r").first()
    assert (r["length_ratio"], r["number_match"], r["entity_match"], r["gap_cases"]) == (1.0, 1.0, 1.0, 0)


def test_layout(spark):
    def span(x, y, t):
        return {"type": "text", "content": t, "bbox": [x, y, x + 10, y + 5]}

    doc = {"pdf_info": [{"page_idx": 0, "page_size": [600, 800], "preproc_blocks": [{"type": "text", "lines": [{"spans": [span(400, 10.2, "right"), span(50, 10, "left")]}, {"spans": [span(50, 30, "next"), {"type": "image", "content": "x", "bbox": [0, 0, 1, 1]}]}]}]}]}
    d = spark.createDataFrame([("d", json.dumps(doc))], "doc string, j string").withColumn("info", layout.pages(F.col("j")))
    assert layout.page_text(d, "doc", "info").first()["text"] == "left right next"
    got = [(r["left"], r["right"]) for r in layout.side_by_side(d, "doc", "info").orderBy("line").collect()]
    assert got == [("left", "right"), ("next", "")]
    recs = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "b"), ("d", 2, 0, "c"), ("d", 4, 0, "e")], "doc string, page int, idx int, t string")
    assert sorted(r["t"] for r in layout.cross_page(recs, "doc", "page", "idx", "t").collect()) == ["a", "b c", "e"]
    lines = spark.createDataFrame([("g", 1, "#1"), ("g", 2, "x"), ("g", 3, "#notes"), ("g", 4, "y")], "g string, o int, t string")
    e = layout.entries(lines, "g", "o", F.col("t").startswith("#"), F.col("t") == "#notes").orderBy("o").collect()
    assert [(r["entry"], r["in_notes"]) for r in e] == [(1, False), (1, False), (2, True), (2, True)]
