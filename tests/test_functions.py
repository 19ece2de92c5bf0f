"""Text rules by micro rows, metrics and similarity by their definitions."""

import difflib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import features, metrics, text
from quern.operators import alignment, augment, builders, chunking, consensus, dedup, filters, joins, splits, windows


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("a [...] b", "a <gap> b"), ("<gap> <gap> x", "<gap>"), ("", ""), (None, ""), ("3 broken lines here", "<gap> here"), ("xxx", "<gap>"), ("ab <gap> , c", "ab <gap>, c"), ("um-x-ma", "um-x-ma")],
)
def test_gaps(spark, given, wanted):
    assert one(spark, given, text.unify_gaps) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("2.5 minas", "2 ½ minas"), ("one half", "½"), ("1½", "1 ½"), ("0.6666", "⅔"), ("1 / 2", "½"), ("3.333 x", "3 ⅓ x"), (None, "")])
def test_fractions(spark, given, wanted):
    assert one(spark, given, text.unify_fractions) == wanted


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (text.squeeze, " a  b\n", "a b"), (text.decode_escapes, "a\\nb\\tc", "a\nb c"), (text.drop_repeated_words, "šumma šumma a", "šumma a"),
        (text.index_accents, "bi2 U3 ma₂", "bí Ù má"), (text.plain_digits, "a₂b³", "a2b3"), (text.join_brackets, "A[ssu]r", "Assur"), (text.strip_html, "<p>a &amp; b</p>", "a & b"),
        (text.compare_form, "A-b, C!", "a b c"), (text.slug, " A b! ", "a-b"), (features.strip_prefix, "OAOD x", "x"),
    ],
)
def test_text_rules(spark, fn, given, wanted):
    assert one(spark, given, fn) == wanted


def test_idempotent(spark):
    for fn in (text.unify_gaps, text.squeeze, text.compare_form):
        x = one(spark, "a [x] xx ... b  (broken line) - <gap> c½", fn)
        assert one(spark, x, fn) == x


def test_unicode_forms(spark):
    assert one(spark, "é", text.nfc) == "é"
    assert one(spark, "éß日", text.strip_marks).startswith("e")
    assert one(spark, "a b a b a b c d", text.drop_repeated_phrases) == "a b c d"


def test_roman(spark):
    assert [one(spark, x, text.roman) for x in ("IX", "xiv", "MCMXCIX", "IIII", "abc", "")] == [9, 14, 1999, None, None, None]


def test_mask(spark):
    assert one(spark, "a{X}b", lambda c: text.mask(c, r"\{[^}]*\}", F.upper)) == "A{X}B"


def test_trim_fragment(spark):
    long = "A sentence. " * 10 + "and a rest"
    assert one(spark, long, text.trim_fragment).endswith("sentence.")
    assert one(spark, "short rest", text.trim_fragment) == "short rest"


def test_metrics():
    assert metrics.sentence_chrf("the cat", "the cat") == pytest.approx(100)
    assert metrics.sentence_bleu("the cat sat on it", "the cat sat on it") == pytest.approx(100)
    assert metrics.sentence_chrf("a", "b") == 0 == metrics.sentence_bleu("", "a")
    # two of three words, one of two pairs, no three-word run (smoothed)
    got = metrics.sentence_bleu("a b c", "a b d")
    assert got == pytest.approx(100 * math.exp((math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2)) / 3))


def test_corpus_is_sum_of_rows(spark):
    d = spark.createDataFrame([("a b c d", "a b c e"), ("x y z", "x y z"), (None, "q")], "h string, r string")
    a = metrics.corpus_metrics(d.repartition(1), "h", "r").first()
    b = metrics.corpus_metrics(d.repartition(5), "h", "r").first()
    assert a == b and 0 < a["bleu"] < 100
    assert metrics.corpus_metrics(d.limit(0), "h", "r").count() == 0


def test_consensus():
    assert consensus.choose([]) == ("", 0.0)
    assert consensus.choose(["a"]) == ("a", 100.0)
    assert consensus.choose(["the cat sat", "the cat sat down", "a dog"])[0] != "a dog"
    for m in ("geom", "chrf", "bleu"):
        assert consensus.choose(["x y z", "x y z w", "q"], m)[0] != "q"


def test_windows():
    assert windows.token_budget_batches([(5, 5), (5, 5), (9, 9), (1, 1)], 20) == [0, 0, 1, 2]
    assert windows.token_budget_batches([(1, 1)] * 3, 100, 2) == [0, 0, 1]


def test_quantile_buckets(spark):
    d = spark.createDataFrame([(i, i) for i in range(8)], "id long, v long")
    got = [r[0] for r in windows.quantile_buckets(d, "v", "id", 3, "b").orderBy("id").select("v_bucket").collect()]
    assert got == ["b_0"] * 3 + ["b_1"] * 2 + ["b_2"] * 3
    same = spark.createDataFrame([(i, 1) for i in range(4)], "id long, v long")
    assert {r["v_bucket"] for r in windows.quantile_buckets(same, "v", "id", 3, "b").collect()} == {"b_0"}


def test_budget_prefix(spark):
    d = spark.createDataFrame([(["aa", "bbb", "cccc", "d"],)], "x array<string>")
    assert d.select(windows.budget_prefix(F.col("x"), F.length, 6, 9).alias("y")).first()["y"] == ["aa", "bbb"]


def test_chunks():
    t = " ".join(f"word{i}" for i in range(200))
    parts = chunking.byte_windows(t, 100, 20)
    assert all(len(p.encode()) <= 100 for p in parts) and parts[0].startswith("word0") and parts[-1].endswith("word199")
    assert chunking.byte_windows("short") == ["short"] and chunking.byte_windows("", least=1) == []
    assert chunking.byte_windows("é" * 300, 100, 0)[0] == "é" * 50
    pairs = chunking.paired_windows(t, t, 100, 20, 1.0)
    assert pairs[0][0].startswith("word0") and pairs[-1][1].endswith("word199") and len(pairs) > 10
    assert chunking.paired_windows("", "a") == []


def test_damage_and_noise():
    rng = lambda: augment.row_rng(1, "k")
    t = "a-na be-li2-ia qi2-bi-ma um-ma"
    assert augment.damage(t, rng(), 1.0) == augment.damage(t, rng(), 1.0) and "<gap>" in augment.damage(t, rng(), 1.0)
    assert augment.damage("a b", rng(), 1.0) == "a b"
    assert augment.ocr_noise("a-na be-li", rng()) != "a-na be-li"


def test_span_mask():
    for n in (2, 3, 10, 100):
        m = augment.span_mask(n, 0.15, 3.0, np.random.default_rng(n))
        assert len(m) == n and 0 < m.sum() < n
    source, target = augment.corrupted(augment.byte_ids("some longer text for spans")[:-1], 7, 0.3, 3.0)
    restored, spans, current = [], {}, None
    for t in target[:-1]:
        if t > 200:
            current = spans.setdefault(t, [])
        else:
            current.append(t)
    for t in source[:-1]:
        restored += spans[t] if t > 200 else [t]
    assert augment.byte_text(restored) == "some longer text for spans"


def test_folds(spark):
    groups = [(f"g{i}", 1 + i % 3, {f"l{i % 2}": 1 + i % 3}, [1.0]) for i in range(60)]
    fold = splits.greedy_folds(groups, 5)
    sizes = [sum(g[1] for g in groups if fold[g[0]] == f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 2
    d = spark.createDataFrame([(i, f"s{i % 7}", f"l{i % 2}", float(i)) for i in range(70)], "id long, grp string, lab string, v double")
    got = splits.holdout(d, "grp", "lab", ["v"], 0.2)
    by = got.groupBy("grp").agg(F.count_distinct("split").alias("n")).collect()
    assert all(r["n"] == 1 for r in by) and got.where("split = 'eval'").count() > 0
    assert splits.exact_split(d, "id", 0.1).where("split = 'eval'").count() == 7
    assert splits.resample(d, "id", 0.5).count() == 35 and splits.resample(d, "id", 2.5).count() == 175


def test_alignment():
    ok = '```json\n{"decision": "keep", "sentence_pairs": [{"transliteration": "a-na be-li", "translation": "To my lord."}]}\n```'
    assert alignment.validate("a-na be-li", "To my lord.", ok) == (True, "", [{"source": "a-na be-li", "target": "To my lord."}])
    assert alignment.hard_reason("<gap> a <gap>", "x", [{"source": "<gap> a", "target": "x"}]) == "gap_filled_source"
    assert alignment.hard_reason("a", "5 sheep", [{"source": "a", "target": "6 sheep"}]) == "number_added"
    assert alignment.boundary_reason([{"target": "He went to the"}, {"target": "house."}]) == "hanging_boundary"
    assert [alignment.parse_payload(x)[1] for x in ("", "no json", "[]", '{"decision": "reject"}')] == ["empty", "invalid", "empty_array", "rejected"]


def test_names(spark):
    d = spark.createDataFrame([("a PN1 b PN12", "x One y Two", {"PN1": "One", "PN12": "Two"})], "s string, t string, m map<string,string>")
    m = builders.mask_names(F.col("s"), F.col("t"), F.col("m"))
    r = d.select(m.alias("x")).select("x.*", builders.unmask_names(F.col("x.target"), F.col("x.held")).alias("back")).first()
    assert (r["source"], r["target"], r["back"]) == ("a <e1> b <e0>", "x <e1> y <e0>", "x One y Two")


def test_weights(spark):
    d = spark.createDataFrame([(0, "⅔", 5)], "m int, p string, s int")
    total = builders.sixths(F.col("m"), F.col("p")) * 60 + F.col("s") * 6
    assert d.select(builders.quantity(total).alias("q")).first()["q"] == "45"


def test_nearest_word(spark):
    t = spark.createDataFrame([("sitten",), ("zzzzzz",), ("a",)], "token string")
    v = spark.createDataFrame([("kitten", 5), ("sitting", 9), ("mitten", 5), ("ab", 1)], "word string, freq long")
    got = {r["token"]: (r["word"], r["distance"]) for r in joins.nearest_word(t, v).collect()}
    assert got == {"sitten": ("kitten", 1), "a": ("ab", 1)}


def test_context_cut(spark):
    d = spark.createDataFrame([(1, 1, "é" * 100), (1, 2, "b"), (2, 1, "c")], "g int, o int, t string")
    got = {(r["g"], r["o"]): r["context"] for r in joins.previous_in_group(d, "g", ["o"], "t", 151).collect()}
    assert got == {(1, 1): "", (1, 2): "é" * 75, (2, 1): ""}


def test_duplicate_ratio(spark):
    d = spark.createDataFrame([([("a", "b"), ("A", "B!"), ("c", "d")],), ([],)], "p array<struct<source:string,target:string>>")
    got = [r[0] for r in d.select(dedup.duplicate_ratio(F.col("p"))).collect()]
    assert got == [pytest.approx(1 / 3), 0.0]


def test_balance(spark):
    assert [one(spark, x, filters.unbalanced) for x in ("(a)", "(a", "a]")] == [False, True, True]
    assert difflib.SequenceMatcher(None, "abc", "abd").ratio() == pytest.approx(2 / 3)


def test_incomplete_equals_its_sql_on_odd_texts(spark, tmp_path):
    """Non-ASCII letters are no word characters, and only ASCII white space without \\x0B may follow the last word, as in the SQL."""
    import duckdb

    from quern.plans.registry import ORACLE, QUERIES

    ends = ["ado. chllaía", "eêan elleêan", "an", "ban", "_an", "9an", "日an", "AN", "x,", "x -", "( a b", "", None]
    tails = ["", " ", "\n", "\r\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\u00a0", "\n\u2028"]
    given = [t and t + x for t in ends for x in tails] + [x + "-y" for x in tails]
    d = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["incomplete"] for r in QUERIES["incomplete_texts"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(c.execute(ORACLE["incomplete_texts"]).fetchall())
    assert {given[i]: x for i, x in got.items()} == {given[i]: x for i, x in want.items()} and len(got) == len(given)
