"""Aggregations over rows, tokens and groups. Counts are pre-aggregated before each exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import let, words


def shares(df: DataFrame, column: str) -> DataFrame:
    """Each value's count and share of the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__all")).alias("share"))  # one row


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, c): how often each group has each value, null values left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c"))


def medians(counts: DataFrame, groups: list[str], value: str, bins: int = 1024) -> DataFrame:
    """(groups, median) from counted values, exact, without a group in one task.

    A group's values are counted by ranges between its least and greatest;
    only the ranges that hold its middle ranks are looked into, and there each
    value once. Groups are equal if null too.
    """
    names = [f"median_group_{i}" for i in range(len(groups))]
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)] or [F.lit(True)]

    def keyed(d: DataFrame, *more) -> DataFrame:
        return d.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], *more)

    spans = keyed(counts.groupBy(*groups).agg(F.min(value).alias("m_least"), F.max(value).alias("m_most"), F.sum("c").alias("m_n")), "m_least", "m_most", "m_n")
    place = F.least(F.floor((F.col(value) - F.col("m_least")) / F.nullif(F.col("m_most") - F.col("m_least"), F.lit(0.0)) * bins), F.lit(bins - 1))
    placed = counts.join(F.broadcast(spans) if not groups else spans, same).withColumn("m_bin", F.coalesce(place, F.lit(0)))  # one row without groups
    placed = placed.select(*groups, value, "c", "m_n", "m_bin")
    sums = placed.groupBy(*groups, "m_bin").agg(F.sum("c").alias("m_in"), F.first("m_n").alias("m_n"))
    w = Window.partitionBy(*groups).orderBy("m_bin")  # at most `bins` rows a group
    sums = sums.withColumn("m_before", F.sum("m_in").over(w) - F.col("m_in"))
    # ranks (n + 1) / 2 and n / 2 + 1, from 1
    low, high = F.floor((F.col("m_n") + 1) / 2), F.floor(F.col("m_n") / 2) + 1

    def holds(rank: Column, start: str, size: str) -> Column:
        return (F.col(start) < rank) & (rank <= F.col(start) + F.col(size))

    middle = sums.where(holds(low, "m_before", "m_in") | holds(high, "m_before", "m_in"))
    middle = keyed(middle, F.col("m_bin").alias("m_middle"), "m_before")
    d = placed.join(middle, [*same, F.col("m_bin") == F.col("m_middle")])
    v = Window.partitionBy(*groups, "m_bin").orderBy(value)
    d = d.withColumn("m_start", F.col("m_before") + F.sum("c").over(v) - F.col("c"))
    pick = d.select(*groups, F.when(holds(low, "m_start", "c"), F.col(value)).alias("m_a"), F.when(holds(high, "m_start", "c"), F.col(value)).alias("m_b"))
    return pick.groupBy(*groups).agg(((F.max("m_a") + F.max("m_b")) / 2).alias("median"))


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, mean, median, low, high, deviation) of a number, from its counted values: one pass over the rows."""
    counts = value_counts(df, groups, value)
    names = [f"summary_group_{i}" for i in range(len(groups))]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], *[c for c in b.columns if c not in groups])
        return a.join(b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)] or [F.lit(True)]).drop(*names)

    g = counts.groupBy(*groups).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    spread = joined(counts, g.select(*groups, "n", "mean")).groupBy(*groups).agg(F.sum(F.col("c") * F.pow(F.col(value) - F.col("mean"), 2)).alias("square"))
    d = joined(joined(g, spread), medians(counts, groups, value))
    return d.select(*groups, "n", "mean", "median", "low", "high", F.when(F.col("n") > 1, F.sqrt(F.col("square") / (F.col("n") - 1))).alias("deviation"))


def ratio_summary(df: DataFrame, value: Column, group: str) -> DataFrame:
    """Mean, median, extremes and sample deviation over all rows (group null) and by group."""
    d = df.select(F.col(group).alias("grp"), value.cast("double").alias("v"))
    return summary(d, ["grp"], "v").unionByName(summary(d, [], "v").withColumn("grp", F.lit(None).cast(d.schema["grp"].dataType)))


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics by fold as one row each: mean, population deviation, median, worst, best, spread."""
    long = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.median("v").alias("median"), F.min("v").alias("worst"), F.max("v").alias("best"), (F.max("v") - F.min("v")).alias("spread"))


def token_counts(df: DataFrame, text: str, lower: bool = True) -> DataFrame:
    """(token, n) over all words of all rows."""
    w = words(F.lower(text) if lower else F.col(text))
    return df.select(F.explode(w).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, text: str, k: int = 30) -> DataFrame:
    """The k most frequent words; ties by the word."""
    return token_counts(df, text).orderBy(F.desc("n"), "token").limit(k)


def rare_token_ratio(df: DataFrame, key: str, text: str, rare: int = 2) -> DataFrame:
    """(key, ratio): the share of a row's words that the whole table has at most `rare` times.

    Words are counted by row first, so that a frequent word crosses the
    exchange once a row and its count is joined to those.
    """
    tokens = df.select(F.col(key).alias("k"), F.explode(words(F.lower(text))).alias("token"))
    by_row = tokens.groupBy("k", "token").agg(F.count(F.lit(1)).alias("c"))
    total = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(F.col("token").alias("t"), "n")
    few = total.where(F.col("n") <= rare)
    hits = by_row.join(few, F.col("token") == F.col("t"), "left").groupBy("k").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("c")).otherwise(0)).alias("few"), F.sum("c").alias("all"))
    hits = hits.select(F.col("k").alias("__k"), (F.col("few") / F.col("all")).alias("ratio"))
    return df.select(key).distinct().join(hits, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("ratio", F.lit(0.0)).alias("rare_token_ratio"))


def _repeat_rate(w: Column, n: int) -> Column:
    """The share of distinct n-grams of an array that it has more than once; null if it is too short."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), "\u0001")))

    def rate(g: Column) -> Column:
        # in order, a repeated n-gram's second place equals the one before, and not the one before that
        again = F.filter(F.sequence(F.lit(2), F.greatest(F.size(g), F.lit(2))), lambda i: (F.get(g, i - 1) == F.get(g, i - 2)) & ((i == 2) | (F.get(g, i - 3) != F.get(g, i - 2))))
        return F.size(again) / F.size(F.array_distinct(g))

    return F.when(F.size(w) >= n, let(F.sort_array(grams), rate))


def ngram_repeats(df: DataFrame, text: str, sizes: tuple[int, ...] = (2, 3, 4, 5, 6, 8)) -> DataFrame:
    """For each n: mean, median and greatest share of a text's distinct n-grams that it has more than once, and texts with any.

    All sizes in one pass, within the row; one number a text and n leaves it.
    """
    rates = let(words(F.col(text)), lambda w: F.array(*[F.struct(F.lit(n).alias("n"), _repeat_rate(w, n).alias("rate")) for n in sizes]))
    rows = df.select(F.explode(rates).alias("x")).select("x.*").where("rate IS NOT NULL")
    counts = value_counts(rows, ["n"], "rate")
    g = counts.groupBy("n").agg((F.sum(F.col("rate") * F.col("c")) / F.sum("c")).alias("mean"), F.max("rate").alias("high"), F.sum(F.when(F.col("rate") > 0, F.col("c")).otherwise(0)).alias("texts_with_repeat"))
    m = medians(counts, ["n"], "rate").withColumnRenamed("n", "of_n")
    return g.join(m, F.col("n") == F.col("of_n")).select("n", "mean", "median", "high", "texts_with_repeat")


def dominant(df: DataFrame, key: str, value: str, support: int = 2, share: float = 0.8) -> DataFrame:
    """Each key's most frequent value, where the key occurs often enough and the value is most of it; ties by the value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(key).agg(F.sum("c").alias("total"), F.max("c").alias("top"), F.min_by(F.col(value), F.struct(-F.col("c"), F.col(value))).alias(value))
    return best.where((F.col("total") >= support) & (F.col("top") / F.col("total") >= share))


def decisive(df: DataFrame, key: str, value: str, factor: float = 2.0) -> DataFrame:
    """Each key's most frequent value where it is at least `factor` times the second."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("c"), value)
    two = counts.withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = two.groupBy(key).agg(F.min_by(value, "r").alias(value), F.max("c").alias("top"), F.sum(F.when(F.col("r") == 2, F.col("c"))).alias("second"))
    return best.where(F.col("second").isNull() | (F.col("top") >= factor * F.col("second"))).select(key, value, "top")


def status_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by each combination, with subtotals."""
    return df.rollup(*columns).agg(F.count(F.lit(1)).alias("n"))


def ordered_text(df: DataFrame, group: str, order: list[str], text: str, separator: str = " ") -> DataFrame:
    """Each group's texts, in order, as one; with the number of parts."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__t"))))
    return df.groupBy(group).agg(parts.alias("__p")).select(group, F.array_join(F.transform("__p", lambda x: x["__t"]), separator).alias(text), F.size("__p").alias("parts"))


def advantages(df: DataFrame, group: str, reward: str, limit: float = 3.0, flat: float = 1e-8) -> DataFrame:
    """Adds `advantage`: how many population deviations a reward is from its group's mean, within the limit; 0 in a flat group.

    The group's mean and deviation are joined, not windowed, so that a large
    group is summed where it lies.
    """
    g = df.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s")).withColumnRenamed(group, "__g")
    z = (F.col(reward) - F.col("__m")) / (F.col("__s") + flat)
    d = df.join(g, F.col(group).eqNullSafe(F.col("__g")))
    return d.withColumn("advantage", F.when(F.col("__s") < flat, 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))).drop("__g", "__m", "__s")


def byte_lengths(df: DataFrame, text: str, cap: int) -> DataFrame:
    """Characters and bytes: least, greatest, mean, and rows over a byte cap."""
    t = F.coalesce(text, F.lit(""))
    return df.agg(F.min(F.length(t)).alias("min_chars"), F.max(F.length(t)).alias("max_chars"), F.avg(F.length(t)).alias("avg_chars"), F.min(F.octet_length(t)).alias("min_bytes"), F.max(F.octet_length(t)).alias("max_bytes"), F.avg(F.octet_length(t)).alias("avg_bytes"), F.count_if(F.octet_length(t) > cap).alias("over_cap"))


def stitched(df: DataFrame, group: str, order: str, starts: Column, text: str) -> DataFrame:
    """Islands: a row that does not start one continues the one before; their texts joined in order."""
    w = Window.partitionBy(group).orderBy(order)
    d = df.select(group, order, text, F.when(starts, 1).otherwise(0).alias("__s")).withColumn("__s", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("__s")))
    d = d.withColumn("island", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(group, "island").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return g.select(group, "island", F.array_join(F.transform("p", lambda x: x[text]), " ").alias(text), F.size("p").alias("parts"))


def weighted_average(vectors: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """Same-shape arrays averaged place by place with weights: (place, value)."""
    d = vectors.select(weight.cast("double").alias("w"), F.posexplode(vector).alias("place", "x"))
    return d.groupBy("place").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def record_summary(df: DataFrame, split: str, masked: str = "masked_spans", annotated: str = "annotated_spans", inputs: str = "input_len", labels: str = "label_len") -> DataFrame:
    """By split: examples, those with annotated spans and their share, spans masked and annotated and their share, mean lengths."""
    some = F.count_if(F.col(annotated) > 0)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("examples"), some.alias("annotated_examples"), F.round(some / F.count(F.lit(1)), 4).alias("annotated_example_ratio"),
        F.sum(masked).alias("masked_spans"), F.sum(annotated).alias("annotated_spans"),
        F.coalesce(F.round(F.try_divide(F.sum(annotated), F.sum(masked)), 4), F.lit(0.0)).alias("annotated_span_ratio"),
        F.round(F.avg(inputs), 2).alias("avg_input_len"), F.round(F.avg(labels), 2).alias("avg_label_len"),
    )


def truncation(df: DataFrame, source: str, target: str, most_source: int, most_target: int) -> DataFrame:
    """By side: lengths in bytes with the end id before and after the cut, how many are cut, and how many end at the cap."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), (F.octet_length(F.coalesce(c, F.lit(""))) + 1).alias("raw"), F.lit(most).alias("cap")) for side, c, most in (("source", source, most_source), ("target", target, most_target))])
    d = df.select(F.explode(sides).alias("x")).select("x.*").withColumn("cut", F.least("raw", "cap"))
    return d.groupBy("side", "cap").agg(
        F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"), F.avg("raw").alias("raw_avg"), F.min("cut").alias("cut_min"), F.max("cut").alias("cut_max"), F.avg("cut").alias("cut_avg"),
        F.count_if(F.col("raw") > F.col("cap")).alias("truncated"), F.count_if(F.col("cut") == F.col("cap")).alias("at_cap"),
    )


def merge_report(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """By part: rows, distinct keys, and keys that a part before it, in the given order, has too."""
    union = None
    for i, (name, df) in enumerate(parts.items()):
        d = df.select(F.lit(i).alias("place"), F.lit(name).alias("part"), F.col(key).cast("string").alias("key"))
        union = d if union is None else union.unionByName(d)
    by_key = union.groupBy("part", "place", "key").agg(F.count(F.lit(1)).alias("c"))
    first = by_key.groupBy("key").agg(F.min("place").alias("first")).withColumnRenamed("key", "first_key")
    d = by_key.join(first, F.col("key").eqNullSafe(F.col("first_key")))
    return d.groupBy("part").agg(F.sum("c").alias("n"), F.count("key").alias("keys"), F.count_if(F.col("place") > F.col("first")).alias("known"))


def reassembled(df: DataFrame, key: str, order: str, text: str, confidence: str, candidates: str) -> DataFrame:
    """Segments as one answer: texts in order, mean confidence, and the distinct candidates in order of their first place."""
    s = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"), F.coalesce(candidates, F.array().cast("array<string>")).alias("c"))))
    d = df.groupBy(key).agg(s.alias("s"), F.avg(confidence).alias(confidence))
    joined = F.array_join(F.filter(F.transform("s", lambda x: F.trim(x["t"])), lambda x: x != ""), " ")
    return d.select(key, joined.alias(text), confidence, F.array_distinct(F.flatten(F.transform("s", lambda x: x["c"]))).alias(candidates), F.size("s").alias("parts"))


def with_fallback(lexicon: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The calibrated entries, and the base lexicon's for keys that have none."""
    known = lexicon.select(F.col(key).alias("known_key"))
    return lexicon.unionByName(base.join(known, F.col(key) == F.col("known_key"), "left_anti").select(*lexicon.columns))
