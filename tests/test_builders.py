from pyspark.sql import functions as F

from quern.operators import builders, evaluation, splits


def test_shifted_negatives(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, t string")
    got = {r["id"]: r["rejected"] for r in builders.shifted_negatives(d, "id", "t", rows=100).collect()}
    assert got == {1: "b", 2: "b", 3: "c", 4: "a"}
    same = spark.createDataFrame([(1, "a"), (2, "a")], "id long, t string")
    assert {r["rejected"] for r in builders.shifted_negatives(same, "id", "t", rows=100).collect()} == {None}
    assert builders.shifted_negatives(same.limit(1), "id", "t", rows=100).first()["rejected"] is None


def test_sources(spark):
    d = spark.createDataFrame([(i, "official" if i % 10 else "ocr") for i in range(200)], "id long, s string")
    got = splits.exact_by_source(d, "id", "s", 0.1)
    assert got.where("split = 'eval'").count() == 20 and got.where("split = 'eval' AND s = 'ocr'").count() == 10
    few = splits.exact_by_source(d.where("id % 100 <> 0"), "id", "s", 0.5)
    assert few.where("split = 'eval' AND s = 'ocr'").count() == 18


def test_months(spark):
    d = builders.month_pairs(spark, 30)
    assert d.count() == 30 and d.where("NOT target_text RLIKE '^Month [0-9]+$'").count() == 0
    x = spark.createDataFrame([("ITU.KAM ke-na-tim",), ("none",)], "t string").select(builders.month_hints(F.col("t")).alias("y"))
    assert [r["y"] for r in x.collect()] == ["ITU.KAM ke-na-tim ## MONTH: ke-na-tim=month 3", "none"]


def test_frames(spark):
    w = spark.createDataFrame([("bītum", "house"), ("awīlum", "man")], "w string, g string")
    got = builders.vocabulary_pairs(w, "w", "g", [("{} a", "the {}"), ("a {}", "a {}"), ("{}", "{}")]).collect()
    assert len(got) == 4 and all(r["w"] in r["source_text"] and "{}" not in r["target_text"] for r in got)


def test_candidates(spark):
    d = spark.createDataFrame([(["a b c ", "a b c", ""], "a b d"), (["x"], " ")], "c array<string>, r string")
    r = builders.scored_candidates(d, "c", "r").collect()
    assert len(r) == 1 and r[0]["c"] == ["a b c", "a b d"] and r[0]["scores"][1] > r[0]["scores"][0]


def test_missed(spark):
    d = spark.createDataFrame([(1, "to puzur", "To Puzur and Assur"), (2, "x", "of Assur")], "id long, p string, r string")
    got = {r["entity"]: (r["n"], r["example"]) for r in evaluation.missed_entities(d, "id", "p", "r").collect()}
    assert got == {"assur": (2, 1), "puzur": (1, 1)}
    b = spark.createDataFrame([(0, 4, 4), (0, 2, 2), (1, 5, 5)], "b int, s int, t int")
    assert tuple(evaluation.batch_fill(b, "b", "s", "t").first()) == (2, 1.5, 0.875)


def test_exact_groups(spark):
    d = spark.createDataFrame([(i, f"g{i % 9}") for i in range(90)], "id long, g string")
    got = splits.exact_group_holdout(d, "g", 25)
    assert got.where("split = 'eval'").count() == 20 and got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.exact_group_holdout(d, "g", 5).where("split = 'eval'").count() == 0


def test_splits_are_alike_at_any_size(spark):
    """Above max_groups: the same folds and splits, and rows of a null group stay."""
    given = [(i, None if i % 11 == 10 else f"g{i % 11}", None if i % 7 == 6 else f"l{i % 7}", float(i)) for i in range(300)]
    d = spark.createDataFrame(given, "id long, grp string, lab string, v double").repartition(3)
    for run in (lambda m: splits.stratified_folds(d, "grp", "lab", ["v"], 4, max_groups=m), lambda m: splits.exact_group_holdout(d, "grp", 90, max_groups=m), lambda m: splits.exact_group_holdout(d, "grp", 5, max_groups=m)):
        small, large = (sorted((r["id"], r[-1]) for r in run(m).collect()) for m in (200_000, 3))
        assert small == large and [i for i, _ in small] == list(range(300))
    folds = splits.stratified_folds(d, "grp", "lab", ["v"], 4, max_groups=3).groupBy("fold").count().collect()
    assert len(folds) == 4 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 28
    got = splits.exact_group_holdout(d, "grp", 90, max_groups=3).where("split = 'eval'")
    assert 63 <= got.count() <= 90


def test_reslice(spark):
    from quern.operators import alignment

    source = "a b c d e f g"
    got = alignment.resliced([{"source": "a b x", "target": "1"}, {"source": "d e", "target": "2"}, {"source": "f", "target": "3"}], source)
    assert " ".join(p["source"] for p in got) == source and got[0]["source"].startswith("a b") and got[2]["source"].endswith("g")
    d = spark.createDataFrame([("a-na₂ 0.3333 x 1.66667 a-na₂ 0.25",), (None,)], "t string").select(alignment.suspicious_forms(F.col("t")).alias("s"))
    assert [(r["s"]["decimals"], r["s"]["subscripts"]) for r in d.collect()] == [(["0.3333", "1.66667"], ["a-na₂"]), ([], [])]
    v = spark.createDataFrame([(1, True, "", []), (2, False, "why", [("a", "b")])], "id int, keep boolean, reason string, pairs array<struct<source:string,target:string>>")
    r = alignment.reject_records(v, "id").collect()
    assert [(x["id"], x["reason"], x["proposed"]) for x in r] == [(2, "why", '[{"source":"a","target":"b"}]')]
