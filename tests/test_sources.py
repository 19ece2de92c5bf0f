import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schema
from quern.sources import tables
from quern.streaming import append


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('row_id,source,x\n1,"a ""b""\nc",\n2,,z\n')
    d = tables.csv_strings(spark, str(tmp_path / "a.csv"), ["row_id", "source", "x"])
    assert [tuple(r) for r in d.orderBy("row_id").collect()] == [("1", 'a "b"\nc', ""), ("2", "", "z")]
    with pytest.raises(ValueError, match="lacks columns: nope"):
        tables.csv_strings(spark, str(tmp_path / "a.csv"), ["row_id"], needed=["nope"])


def test_pairs_of(spark, tmp_path):
    (tmp_path / "h.csv").write_text("akk,eng\na,b\n")
    (tmp_path / "n.csv").write_text("a,b\nc,d\n")
    (tmp_path / "j.jsonl").write_text(json.dumps({"s": "é", "t": "y"}) + "\n")
    assert tables.pairs_of(spark, str(tmp_path / "h.csv"), ["s", "t"], {"akk"}, {"eng"}).columns == ["akk", "eng"]
    assert tables.pairs_of(spark, str(tmp_path / "n.csv"), ["s", "t"], {"akk"}, {"eng"}).count() == 2
    assert tables.pairs_of(spark, str(tmp_path / "j.jsonl"), ["s", "t"], set(), set()).first()["s"] == "é"


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"123")
    d = tables.files(spark, str(tmp_path), ".pdf").withColumn("pages", F.lit(4))
    rules = tables.page_rules(["a:1-3,5", "b.pdf:2"])
    assert rules == [("a", [1, 2, 3, 5]), ("b.pdf", [2])]
    r = tables.selected_pages(d, rules).first()
    assert (r["name"], r["bytes"], r["selected"]) == ("a.pdf", 3, [1, 2, 3])
    assert tables.selected_pages(d, [("z", [1])]).first()["selected"] is None
    for bad in ("a:", "a:3-1", "a:0", ":1", "a:x"):
        with pytest.raises(ValueError):
            tables.page_rules([bad])


def test_atf(spark):
    lines = ["#junk", "&P000001 = X", "#atf: lang akk", "1. a-na", "#tr.en: To", "2. be-li", "&P000002", "1'. um-ma"]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, value string")
    got = {r["id"]: (r["language"], r["source_text"], r["target_text"]) for r in tables.atf_records(d).collect()}
    assert got == {"P000001": ("akk", "a-na be-li", "To"), "P000002": ("", "um-ma", "")}


def test_first_filled(spark):
    text, name = tables.first_filled(["a", "b"])
    d = spark.createDataFrame([(" ", "x"), ("y", "z"), (None, None)], "a string, b string")
    assert [tuple(r) for r in d.select(text, name).collect()] == [("x", "b"), ("y", "a"), ("", None)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("é", "x")], "t string, lang string")
    tables.write_json_lines(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["t"] == "é"
    tables.write_split(d, str(tmp_path / "p"), "lang")
    assert (tmp_path / "p" / "lang=x").is_dir()
    tables.write_csv(d, str(tmp_path / "c"), one_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert json.loads(tables.report(d)) == [{"t": "é", "lang": "x"}]


def test_append_stream(spark, tmp_path):
    layout = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, layout).write.mode("append").parquet(src)
        append.append_corpus(spark, src, layout, out, check).awaitTermination()
        return spark.read.parquet(out).count()

    assert arrive([(1, "first paragraph\nsecond paragraph"), (2, "first  paragraph")]) == 2
    assert arrive([(3, "second paragraph\n\nthird paragraph"), (4, None)]) == 3


def test_pairs_schema(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 3, "user", "c"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in schema.conversation_pairs(d).select("row_id", "source_text", "target_text").collect()] == [("1-0", "a", "")]
