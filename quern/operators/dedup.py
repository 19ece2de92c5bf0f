"""Exact deduplication that keeps the first row in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import compare_form, let, squeeze, words
from quern.operators.joins import first_by
from quern.schema import unused


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order; copies meet in partial sums before the exchange."""
    return first_by(df, keys, [F.col(o) for o in order])


def keep_first_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each text, null among them, the first in order; `order` tells rows apart. Texts are told by their SHA-256.

    Only digests and the order go through an exchange: what is not the first
    of its digest is taken out by an anti-join on the order, which is a
    broadcast where the copies are few. Texts stay where they are.
    """
    own, other = unused("text_digest", df), unused("copy_order", df)
    marks = df.select(F.coalesce(F.sha2(text, 256), F.lit("")).alias(own), F.col(order).alias(other))
    first = marks.groupBy(own).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed(own, "same")
    copies = marks.join(first, F.col(own) == F.col("same")).where(F.col(other) > F.col("least")).select(other)
    return df.join(copies, F.col(order) == F.col(other), "left_anti")


def keep_first_pair(df: DataFrame, source: str, target: str, order: str) -> DataFrame:
    return keep_first(df, [source, target], [order])


def fingerprint(text: Column) -> Column:
    """A 256-bit digest of the normalised text."""
    return F.sha2(squeeze(text), 256)


def keep_first_fingerprint(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each normalised text; only the digest is exchanged with the row."""
    return keep_first(df.withColumn("__fp", fingerprint(F.col(text))), ["__fp"], [order]).drop("__fp")


def distinct_trimmed(texts: Column) -> Column:
    """An array's distinct non-blank texts, trimmed, in the order of their first places."""
    return F.array_distinct(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != ""))


def duplicate_ratio(pairs: Column) -> Column:
    """Of an array of structs (source, target): the share whose normalised pair came before."""
    keys = F.transform(pairs, lambda p: F.concat_ws("\u0001", compare_form(p["source"]), compare_form(p["target"])))
    return F.when(F.size(pairs) > 0, 1 - F.size(F.array_distinct(keys)) / F.size(pairs)).otherwise(0.0)


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct words over all distinct words, in percent; 100 for two empty texts."""
    sides = F.struct(words(F.lower(a)).alias("x"), words(F.lower(b)).alias("y"))

    def share(s: Column) -> Column:
        both = F.size(F.array_union(s["x"], s["y"]))
        return F.when(both == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect(s["x"], s["y"])) / both)

    return let(sides, share)


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many items two arrays share, counting repeats: each distinct item counts its lesser number."""
    def times(xs, v):
        return F.size(F.filter(xs, lambda x: x == v))

    sides = F.struct(a.alias("a"), b.alias("b"))
    return let(sides, lambda s: F.aggregate(F.array_intersect(s["a"], s["b"]), F.lit(0), lambda n, v: n + F.least(times(s["a"], v), times(s["b"], v))))
