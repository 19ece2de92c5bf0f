"""Small kernels, rules of editions and whole family builds, by rows whose result is known."""

import hashlib
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern import schema
from quern.functions import editions, features, metrics, records, roles, similarity, text
from quern.operators import aggregates, alignment, augment, builders, chunking, dedup, family, filters, joins, names, screening, splits, windows
from quern.sources import tables


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (records.without_side_marks, "a obv. b le.e. c", "a b c"), (records.joined_brackets, "a-hu-u[r] x[]y", "a-hu-ur xy"), (records.without_left_prefix, "12* 3 obv. a-na", "a-na"), (records.without_left_prefix, "5 6* ., b", "b"),
        (lambda c: records.visual_noise(c, True), "a – *b … <<c>>", "a - b ... <<c>>"), (lambda c: records.visual_noise(c, False), "<<a>>*b", "ab"), (records.bare_length, " a b\n", 2), (lambda c: records.page_text(c, 3), " a  bcd", "a b"), (records.page_text, None, ""),
        (records.without_fences, "```json\n{1}\n```", "{1}"), (records.without_fences, " x ", "x"), (records.without_fences, "```\na", "a"), (records.without_fences, None, ""), (records.first_word, "12 Ša-x y", "ša"), (records.last_word, "a Be!", "be"), (records.last_word, "12", ""),
        (records.ends_sentence, 'so."', True), (records.ends_sentence, "so <gap>", True), (records.ends_sentence, "so,", False), (lambda c: records.cut_with_note(c, 3), "abcde", "abc...[truncated 2 chars]"), (lambda c: records.cut_with_note(c, 5), "abcde", "abcde"),
        (records.variety_or, "  ", "OA"), (records.variety_or, None, "OA"), (records.variety_or, "OB", "OB"), (records.adjacent_gaps, "<gap>  <gap> a <gap>-<gap>", "<gap> a <gap>-<gap>"), (records.without_case, "šar-ra-tim", "šar-ra"), (records.without_case, "a-wi-lum", "a-wi-lum"), (records.without_case, "be-lí-šu", "be-lí"),
        (records.plain_token, " gu₄ ", "gu4"), (records.entry_stem, "abu XI ", "abu"), (records.linked_word, "x?word=ab c ", "ab c"), (records.linked_word, "x?w=a", None), (records.without_echo, "Examples:\na => b\nto English: Yes ", "Yes"), (records.without_echo, "Yes ## HINTS: a", "Yes"), (records.without_echo, None, ""),
        (records.escaped_breaks, "nTell n me (nA) nan", "\nTell   me (\nA) nan"), (records.catalogue_key, " 12 ", "000012"), (editions.broken_braces, "{d-<gap> {d- x {} {ki}", "<gap> <gap> x  {ki}"), (editions.answer_only, "a | b || c ## MONTH: x", "c"), (editions.light, "1-2* “a”\n3 b-/c obv. d", '"a" bc d'),
        (editions.light_target, "He said , nWell }", "He said, Well"), (editions.read_source, "ša¹ ș đA ma-/ na a..b", "ša1 ṣ {d}A ma-na a <gap> b"), (editions.read_target, "rece 20 e. ived² obv. x", "rece  ived   x"), (editions.page_line, "short", ""), (editions.page_line, "12", ""), (editions.page_line, "a long\x07 enough  line", "a long enough line"),
        (editions.corpus_source, "0.5 ma₄", "½ ma4"), (editions.corpus_target, "the [king] (broken here) gave (silver) S,ab", "the king gave silver Ṣab"), (lambda c: text.preview(c, 2), "abc", "ab..."), (lambda c: text.allow(c, "abc "), "axbéc", "a b c"), (lambda c: records.document_id(c), "a b/c.pdf", "a_b__c__" + hashlib.sha1(b"a b/c").hexdigest()[:10]),
        (records.snapped_decimals, "2.3334 x 0.5 1.234", "2 ⅓ x ½ 1.234"), (records.sanitized_braces, "{ki} {a{b}c} {too long here} }", "{ki}"), (lambda c: records.task_id(F.lit("t"), F.lit(7)), "", "t-000007"),
    ],
)
def test_rules(spark, fn, given, wanted):
    assert one(spark, given, fn) == wanted


def test_ids(spark):
    d = spark.createDataFrame([("a/é.pdf", 3, 1, "a-na", "to"), ("x", 0, 0, "", "")], "p string, n int, i int, s string, t string")
    got = d.select(records.pair_id(*(F.col(c) for c in "pnist")).alias("id")).collect()
    assert [r["id"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{p}::page={n}::pair={i}::{s}::{t}")) for p, n, i, s, t in [("a/é.pdf", 3, 1, "a-na", "to"), ("x", 0, 0, "", "")]]


def test_lines_and_entries(spark):
    lines = [(True, "", 1, "1'", "e"), (False, "ii", 1, "1", "c"), (False, "", 2, None, "b"), (False, "", 1, "1", " a "), (False, "", 3, "3", " ")]
    d = spark.createDataFrame([(lines,)], "l array<struct<envelope:boolean,column:string,line:int,label:string,text:string>>")
    assert d.select(records.ordered_lines(F.col("l")).alias("x")).first()["x"] == "1 a\n2 b\n1 c\n1' e"
    d = spark.createDataFrame([("g", "m"), ("", 'to "go" or "run"'), (None, "plain"), (None, None)], "g string, m string")
    assert [r["x"] for r in d.select(records.entry_gloss(F.col("g"), F.col("m")).alias("x")).collect()] == ["g", "go", "", ""]


def test_padding(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([],)], "i array<int>").select(records.padded(F.col("i"), F.lit(2), 9).alias("x"), records.padded(F.col("i"), F.lit(4)).alias("y"))
    a, b = d.collect()
    assert (a["x"]["ids"], a["x"]["mask"], a["y"]["ids"], a["y"]["mask"]) == ([1, 2], [1, 1], [1, 2, 3, 0], [1, 1, 1, 0]) and b["x"]["ids"] == [9, 9]


def test_roles(spark):
    t = "a-na [x b] x <gap> 2½ ... {ki}"
    ids = [b + 3 for b in t.encode()] + [1, 300]
    got = roles.roles(np.array(ids)).tolist()
    spelled = "".join("PASBDN"[r] for r in got)  # pad, alpha, separator, boundary, damage, number
    assert spelled[:-2] == "ASAASBDSABSASDDDDDSNNNSDDDSBAAB" and spelled[-2:] == "PP"
    assert roles.DAMAGE not in roles.roles(np.array(ids), frozenset({roles.DAMAGE})) and roles.NUMERIC not in roles.roles(np.array(ids), frozenset({roles.NUMERIC}))
    d = spark.createDataFrame([(t,), ("é",), (None,)], "t string").select(roles.text_ids(F.col("t")).alias("ids"))
    assert [r["ids"] for r in d.collect()] == [ids[:-2], [198, 172], []]
    assert d.select(roles.byte_roles("ids").alias("r")).first()["r"] == got[:-2]
    counts = {r["role"]: r["n"] for r in roles.role_distribution(d, "ids").collect()}
    assert counts["numeric"] == 3 and sum(counts.values()) == len(ids)
    assert roles.role_distribution(d.limit(0), "ids").where("n > 0").count() == 0


# functions that no registered query names


def test_pair_actions(spark):
    d = spark.createDataFrame([("a " * 30, "b c", "x"), ("a b c d e f g", "word " * 20, "x"), ("a b", "c", "x"), ("a " * 30, "b", "OCR"), ("a b c d e f", "abcdef", "x")], "s string, t string, o string")
    assert [r["a"] for r in d.select(filters.action(F.col("s"), F.col("t"), F.col("o")).alias("a")).collect()] == ["trim_source", "trim_target", "protected", "skip", "keep"]
    d = spark.createDataFrame([("Lexical",), ("letter",), (None,)], "g string")
    assert [r["b"] for r in d.select(filters.blocked_genre(F.col("g"), ["lexical", "school"]).alias("b")).collect()] == [False, True, True]
    d = spark.createDataFrame([(0.9, "abcd", "abcd"), (0.1, "abcd", "abcd"), (0.9, "abcd", "abcdefghijkl")], "c double, s string, t string")
    assert [r["b"] for r in d.select(filters.confident(F.col("c"), F.col("s"), F.col("t"), 0.5).alias("b")).collect()] == [True, False, False]


def test_joins_of_parts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    parts = spark.createDataFrame([(2, "y1"), (2, "y2")], "k int, t string")
    assert sorted(map(tuple, joins.replaced_by_parts(a, parts, "k").collect())) == [(1, "x"), (2, "y1"), (2, "y2")]
    forms = spark.createDataFrame([("f1", "w1", "g1"), ("f2", "w2", "g2"), ("f3", "w3", None)], "form string, word string, guide string")
    entries = spark.createDataFrame([("w1", "d1"), ("w2", None)], "word string, def string")
    assert sorted(map(tuple, joins.two_hop(forms, entries, "form", "word", "def", "guide").collect())) == [("f1", "d1"), ("f2", "g2")]
    assert [r["index"] for r in windows.running_index(a.withColumn("g", F.lit(1)), "g", "k").orderBy("k").collect()] == [0, 1]
    d = spark.createDataFrame([([" a", "b ", "", "a"],)], "x array<string>")
    assert d.select(dedup.distinct_trimmed(F.col("x")).alias("y")).first()["y"] == ["a", "b"]


def test_shares_and_hints(spark):
    a, b = spark.range(50).selectExpr("id", "'a' AS task"), spark.range(3).selectExpr("id", "'b' AS task")
    got = builders.task_mix([(a, 0.4), (b, 0.6)], "id", 10).groupBy("task").count().collect()
    assert {r["task"]: r["count"] for r in got} == {"a": 4, "b": 3}
    mixed = augment.task_share(b, a, "id", 0.5).groupBy("task").count().collect()
    assert {r["task"]: r["count"] for r in mixed} == {"a": 3, "b": 3} and augment.task_share(a, b, "id", 0.5).count() == 53
    d = spark.createDataFrame([("x y x z", {"x": "1", "z": "2", "q": "3"})], "t string, m map<string,string>")
    assert d.select(features.hints(F.col("t"), F.col("m")).alias("h")).first()["h"] == ["x=1", "z=2"]
    d = spark.createDataFrame([("a-na bīt abim",)], "t string")
    lexicon = F.create_map(F.lit("bīt"), F.lit("house"), F.lit("a-na"), F.lit("to, for"))
    assert d.select(augment.glossed(F.col("t"), lexicon).alias("x"), augment.glossed(F.lit("zz"), lexicon).alias("y")).first()[:] == ("a-na bīt [house] abim", None)


def test_number_shares(spark):
    d = spark.createDataFrame([("2 ½ minas, 1/2 and 10", "10 and 2½")], "r string, h string")
    got = d.select(metrics.number_tokens(F.col("r")).alias("r"), metrics.number_tokens(F.col("h")).alias("h"), metrics.match_share(metrics.number_tokens(F.col("r")), metrics.number_tokens(F.col("h"))).alias("s")).first()
    assert got["r"] == ["2½", "1/2", "10"] and got["h"] == ["2½", "10"] and got["s"] == pytest.approx(2 / 3)
    d = spark.createDataFrame([("abcd", "abXd"), ("", "ab"), (None, None)], "h string, r string")
    assert [r["x"] for r in d.select(similarity.opcode_error_rate("h", "r").alias("x")).collect()] == pytest.approx([0.25, 1.0, 0.0])


def test_schema_and_clients(spark):
    d = spark.createDataFrame([(1,)], "a int")
    assert d.select(schema.optional(d, "a", 5).alias("x"), schema.optional(d, "b", 5).alias("y")).first()[:] == (1, 5)

    def client(batches):
        for b in batches:
            yield pd.DataFrame({"a": b["a"], "answer": "x"})

    assert tables.enriched(d, client, "a int, answer string").first()["answer"] == "x"
    v = spark.createDataFrame([(1, True, "", [("s1", "t1"), ("s2", "t2")]), (2, False, "r", [("a", "b")])], "id int, keep boolean, reason string, pairs array<struct<source:string,target:string>>")
    assert [tuple(r) for r in alignment.keep_records(v, "id").orderBy("index").collect()] == [(1, 0, "s1", "t1"), (1, 1, "s2", "t2")]


def test_orders(spark):
    d = spark.createDataFrame([(1, "aaa", "b"), (2, "a", ""), (3, "aa", "bb"), (4, None, "x")], "o int, s string, t string")
    assert [r["o"] for r in windows.curriculum(d, "s", "t", "o").collect()] == [2, 4, 1, 3] and [r["o"] for r in windows.curriculum(d, "s", "t", "o", True).collect()] == [1, 3, 2, 4]
    assert windows.first_changed(d, F.col("s"), F.when(F.col("o") > 1, "z").otherwise(F.col("s")), "o").first()["o"] == 2
    n = spark.createDataFrame([("b", "x"), ("aaa", "y"), ("aa", "z")], "form string, norm string")
    assert [r["form"] for r in names.longest_first(n).collect()] == ["aaa", "aa", "b"]
    got = splits.with_place(spark.range(100).selectExpr("id % 10 AS a", "id").repartition(7), "a", "id").collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (r["a"], r["id"]))] == list(range(100)) and splits.with_place(spark.range(0).toDF("a"), "a").count() == 0
    assert [r["id"] for r in family.gathered([spark.range(3, 5), spark.range(0, 3)], "id").collect()] == list(range(5))
    x = splits.rank_shard(spark.range(10), "id", 3, 4)
    assert [r["id"] for r in x.orderBy("id").collect()] == [9]


def test_texts_are_loaded_once(spark):
    d = spark.createDataFrame([(1, " same text here "), (2, "same text here"), (3, "tiny"), (4, "word " * 200), (5, None)], "o int, t string")
    got = chunking.load_texts(d, "o", "t").collect()
    assert {r["o"] for r in got} == {1, 4} and sum(r["o"] == 4 for r in got) > 2 and len(chunking.load_texts(d, "o", "t", distinct=False).where("o = 2").collect()) == 1


def test_reports_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, g string, v double, t string")
    assert aggregates.summary(empty, ["g"], "v").count() == 0 and aggregates.merge_report({"a": empty, "b": empty}, "k").count() == 0 and aggregates.truncation(empty, "t", "t", 5, 5).count() == 0
    assert chunking.cropped_halves(empty.select(F.col("k").alias("s"), "t"), "s", "t").count() == 0 and names.name_whitelist(empty, "t").count() == 0


# screens and families


def test_screens_take_nulls(spark):
    d = spark.createDataFrame([(None, None, None, None), ("", "", "", ""), ("a-na x", "the date", "sentence", "3 - 3")], "s string, t string, a string, l string")
    s, t, a, ref = (F.col(c) for c in "stal")
    got = d.select(screening.fragmentary(s, t), screening.residual_editorial(t), screening.sentence_metadata(t, a).alias("m"), screening.has_placeholder(s, t), screening.single_line_sentence(s, t, a, ref), screening.french(t), screening.foreign(t), screening.high_damage(t, a), screening.candidate_reason(s, t), screening.upload_excluded(s)).collect()
    assert len(got) == 3 and got[2]["m"] is True


def test_document_reasons_reach_over_rows(spark):
    d = spark.createDataFrame([("x", 1, "a royal"), ("x", 2, "inscription of"), ("y", 1, "nothing"), (None, 1, "an omen"), ("z", 1, None)], "d string, o int, t string")
    got = {r["d"]: r["reasons"] for r in screening.document_reasons(d, "d", ["o"], ["t"]).collect()}
    assert got == {"x": "royal", None: "divination"}
    assert {r["drop_reason"] for r in screening.with_document_reasons(d, "d", screening.document_reasons(d, "d", ["o"], ["t"])).where("d IS NULL").collect()} == {"divination"}


def test_french_rows(spark):
    rows_ = [(1, "Pourquoi as-tu donné? Say to him: go.", None), (2, "ainsi parle toi moi", None), (3, "ainsi parle toi moi", "He speaks."), (4, "ainsi parle toi moi", "<DROP>"), (5, "plain", None), (2, "good text", None), (None, None, None)]
    d = spark.createDataFrame(rows_, "k int, t string, a string")
    got = sorted(((r["k"], r["t"], r["french_state"]) for r in screening.repaired_or_dropped(d, "k", "t", "a").collect()), key=str)
    assert got == [(1, "Say to him: go.", "recovered"), (3, "He speaks.", "repaired"), (5, "plain", "kept"), (None, None, "kept")]


def test_sentence_family(spark):
    good = "the king sent silver to the merchant and the merchant gave the silver back"
    long = "a-na šar-ri kaspam ù tamkārum kaspam utēr ana bītim u alim lā"
    rows_ = [
        ("0123abcd-p1", 1, "12 " + long, good, "doc", None), ("0123abcd-p1", 2, long, good + " again", "doc", None), ("p2", 1, long, "a hymn to the king and a long song of the temple of the city", "doc", None),
        ("p3", 1, long, "PN1 " + good, "doc", None), ("p4", 1, "a", good, "sentence", "3-3"), ("p5", 1, long, "<gap> x <gap> y <gap> z", "doc", None), ("p6", 1, long, "ainsi parle toi moi et le roi dit encore", "doc", None), ("p7", 1, "", good, "doc", None), (None, 1, long, good, "doc", None),
    ]
    d = spark.createDataFrame(rows_, "row_id string, ord int, source_text string, target_text string, align_type string, line_ref string")
    got = [tuple(r) for r in family.sentence_family(d).collect()]
    assert [(r[0], r[2], r[3]) for r in got] == [("p1", good, "OB")] and not got[0][1].startswith("12")
    assert family.sentence_family(d.limit(0)).count() == 0


def test_other_families(spark):
    d = spark.createDataFrame([("1", 1, "1(diš) gin2", "one shekel", True), ("2", 2, None, "x", True), ("3", 3, "a", "...", True), ("1", 4, "b c d", "again one two", True), ("4", 5, "x", "not flagged here", False)], "row_id string, ord int, source_text string, target_text string, flag boolean")
    got = family.catalogue_family(d, "OB")
    assert sorted(r["row_id"] for r in got.collect()) == ["1", "1", "4"] and {r["variety"] for r in got.collect()} == {"OB"}
    got = family.flagged_subset(d, "row_id", "ord", F.col("flag"), "OA").collect()
    assert [(r["row_id"], r["ord"]) for r in got] == [("1", 4)]
    assert family.merged(d.where("ord < 3"), d.where("ord > 2"), "row_id", origin="new").where("origin = 'new'").count() == 2
    keys = family.pair_keys(spark.createDataFrame([("a [x] b", "He\\nsaid."), ("a <gap> b", "He said.")], "source_text string, target_text string"))
    assert keys.select("pair_key").distinct().count() == 1
    p = spark.createDataFrame([(1, "a-na A-šùr qí-bi-ma", "Say to Ashur: he gave silver."), (1, "the of and", "x"), (2, "a", "b")], "page int, source_text string, target_text string")
    got = family.page_candidates(p, ["page"])
    assert {(r["page"], r["reason"], r["page_ok"]) for r in got.collect()} == {(1, None, True), (1, "weak_transliteration", True), (2, "weak_transliteration", False)}
    x = family.inference_inputs(p.withColumn("v", F.lit("OB")), "source_text", "v", months=True).first()["input_text"]
    assert x == "OBOI a-na A-šùr qí-bi-ma"
    d = spark.createDataFrame([("OB",), ("zz",), (None,)], "v string").select(family.task_prefix(F.col("v"), {"OB": "old: "}, "any: ").alias("p"))
    assert [r["p"] for r in d.collect()] == ["old: ", "any: ", "any: "]


def test_alignment_counts(spark):
    d = spark.createDataFrame([("2 ½ ma-na <GAP> 1/3 of <gap> 10.5", "minas", "mina"), ("", "ab", "abcdef"), (None, None, "x")], "t string, a string, b string")
    got = d.select(alignment.word_tokens(F.col("t")).alias("n"), alignment.number_list(F.col("t")).alias("x"), filters.gap_count(F.col("t")).alias("g"), similarity.fuzzy_word("a", "b").alias("f"), editions.evaluated(F.col("t")).alias("e")).collect()
    assert (got[0]["n"], got[0]["x"], got[0]["g"]) == (10, ["2", "½", "1/3", "10.5"], 2) and [r["f"] for r in got] == [True, False, False] and got[1]["e"] == ""


def test_helper_columns_clash_with_none(spark):
    """Tables that have columns of the helpers' names."""
    names_ = ["other_k", "row_in_key", "review_key", "reviewed_t", "older_key", "older_text", "found_key", "found_text", "copy_order", "text_digest", "greatest_text"]
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "k int, t string").withColumns({c: F.lit("x") for c in names_})
    other = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (9, "q", 3)], "k int, t string, o int")
    assert joins.override(d, other, "k", ["t"], F.col("o")).where("t = 'z'").count() == 1
    assert joins.backfill(d, other, "k", "t", F.col("o")).count() == joins.restore_longer(d, other, "k", "t", F.col("o")).count() == 5
    assert joins.missing_from(d, other, ["k"]).columns == d.columns and joins.missing_from(d, other, ["k"]).count() == 4
    assert joins.complete(d.drop("t"), other.where("o = 1"), "k", "t").where("t = 'z'").count() == 1
    assert sorted(r["k"] for r in joins.first_by(d, ["t"], [F.col("k")]).collect()) == [1, 2, 4]
    assert sorted(r["k"] for r in dedup.keep_first_text(d, "t", "k").collect()) == [1, 2, 4] and dedup.keep_first_text(d, "t", "k").columns == d.columns
    assert dedup.keep_first_text(d.limit(0), "t", "k").count() == 0
