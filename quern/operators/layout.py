"""Page layout: spans of nested page JSON, lines by position, columns, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.windows import line_groups

SPAN = "struct<type:string,content:string,bbox:array<double>>"
PAGE = f"struct<page_idx:int,page_size:array<double>,preproc_blocks:array<struct<type:string,bbox:array<double>,lines:array<struct<spans:array<{SPAN}>>>>>>"


def pages(json: Column) -> Column:
    """The pages of a document's JSON."""
    return F.from_json(json, f"struct<pdf_info:array<{PAGE}>>")["pdf_info"]


def spans(df: DataFrame, key: str, info: str) -> DataFrame:
    """(key, page, width, x0, y0, x1, y1, text) of every text span with content and a box."""
    p = df.select(key, F.posexplode(info).alias("__i", "p"))
    p = p.select(key, (F.coalesce("p.page_idx", "__i") + 1).alias("page"), F.get("p.page_size", F.lit(0)).alias("width"), F.explode("p.preproc_blocks").alias("b"))
    s = p.select(key, "page", "width", F.explode(F.flatten(F.transform("b.lines", lambda x: x["spans"]))).alias("s"))
    s = s.where((F.col("s.type") == "text") & (F.size("s.bbox") == 4) & (F.trim("s.content") != ""))
    box = [F.get("s.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return s.select(key, "page", "width", *box, F.trim("s.content").alias("text"))


def page_text(df: DataFrame, key: str, info: str) -> DataFrame:
    """(key, page, text): a page's spans in reading order, by the rounded top and then the left edge."""
    s = spans(df, key, info)
    g = s.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct(F.bround("y0").alias("y"), "x0", "text"))).alias("p"))
    return g.select(key, "page", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def columns(lines: DataFrame, share: float = 0.52) -> DataFrame:
    """Adds `side`: left of the share of the page's width, or right."""
    return lines.withColumn("side", F.when(F.col("x0") < share * F.col("width"), "left").otherwise("right"))


def from_two_runs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, page, line, left, right): the left column of one run's lines beside the right column of another's, page by page.

    Pages that only the first run has keep their left column alone.
    """
    a = left.select(key, "page", "line", "left")
    b = right.select(F.col(key).alias("own_key"), F.col("page").alias("own_page"), F.col("line").alias("own_line"), "right")
    on = (F.col(key) == F.col("own_key")) & (F.col("page") == F.col("own_page")) & (F.col("line") == F.col("own_line"))
    return a.join(b, on, "left").select(key, "page", "line", "left", F.coalesce("right", F.lit("")).alias("right"))


def side_by_side(df: DataFrame, key: str, info: str, tolerance: float = 3.0, share: float = 0.52) -> DataFrame:
    """(key, page, line, left, right): the texts of both columns line by line."""
    s = columns(spans(df, key, info), share).withColumn("__page", F.concat_ws("\u0001", key, "page"))
    s = line_groups(s, "__page", "y0", "x0", tolerance)

    def text(side: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("x0", "text"))))
        return F.array_join(F.transform(own, lambda x: x["text"]), " ").alias(side)

    return s.groupBy(key, "page", "line").agg(text("left"), text("right"))


def entries(lines: DataFrame, group: str, order: str, header: Column, notes: Column) -> DataFrame:
    """Adds `entry`, a running count of headers, and `in_notes`, whether the last header opened a notes section."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"entry": F.sum(F.when(header, 1).otherwise(0)).over(w), "__n": F.when(header, notes)})
    return d.withColumn("in_notes", F.coalesce(F.last("__n", ignorenulls=True).over(w), F.lit(False))).drop("__n")


def cross_page(records: DataFrame, document: str, page: str, index: str, text: str) -> DataFrame:
    """Records that go on at the top of the next page join the page's last record: islands of neighbouring pages.

    Each page's first record continues the page before if `index` is 0 there
    and that page has records.
    """
    w = Window.partitionBy(document).orderBy(page, index)
    goes_on = (F.col(index) == 0) & (F.lag(page).over(w) == F.col(page) - 1)
    d = records.withColumn("__s", F.when(goes_on, 0).otherwise(1))
    d = d.withColumn("island", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(document, "island").agg(F.min(page).alias(page), F.array_sort(F.collect_list(F.struct(page, index, text))).alias("p"))
    return g.select(document, page, "island", F.array_join(F.transform("p", lambda x: x[text]), " ").alias(text), F.size("p").alias("parts"))
