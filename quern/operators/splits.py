"""Splits and samples that depend on keys and seeds alone, never on the partitioning."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def resample(df: DataFrame, key: str, weight: float, seed: int = 42) -> DataFrame:
    """int(n x weight) rows, at least one: a hash order without replacement below weight 1, with replacement above.

    With replacement, the draws are numbers that look rows up by their place
    in hash order.
    """
    if weight == 1:
        return df
    n = df.count()
    m = max(1, int(n * weight))
    if weight < 1:
        return first_drawn(df, key, m, seed)
    spark = df.sparkSession
    whole, rest = divmod(m, max(n, 1))
    more = first_drawn(df, key, rest, seed)
    return df.crossJoin(F.broadcast(spark.range(whole).select(F.lit(1).alias("__c")))).drop("__c").unionByName(more)  # as many rows as the weight


def hash_split(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `split`: groups go whole to eval or train by a hash of the group."""
    return df.withColumn("split", F.when(draw(seed, F.col(group)) < share, "eval").otherwise("train"))


def exact_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `split`: exactly max(1, int(n x share)) rows, but not all, are eval, by hash order."""
    n = df.count()
    m = min(max(1, int(n * share)), max(n - 1, 0))
    return df.withColumn("split", F.when(_drawn(df, key, m, seed), "eval").otherwise("train"))


def last_drawn(df: DataFrame, key: str, m: int, seed: int, bins: int = 4096, few: int = 100_000) -> tuple[int, object] | None:
    """(hash, key) of the m-th row in hash order; None for none.

    The rows are counted by ranges of their hash, then by ranges within the
    one that holds the cut, until it has few rows: those alone are sorted. No
    task takes more than `few` rows, however many m is.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    d = df.select(h.alias("h"), F.col(key).alias("k")).where("k IS NOT NULL")
    low, width = 0, 1 << 40
    while m > 0:
        part = max(1, width // bins)
        inside = d.where((F.col("h") >= low) & (F.col("h") < low + width))
        counts = {r["b"]: r["n"] for r in inside.groupBy(F.floor((F.col("h") - low) / part).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `bins` + 1 numbers
        for b in sorted(counts):
            if m <= counts[b]:
                low, width, size = low + b * part, part, counts[b]
                break
            m -= counts[b]
        else:
            return None
        if size <= few or width == 1:
            return tuple(d.where((F.col("h") >= low) & (F.col("h") < low + width)).orderBy("h", "k").limit(m).agg(F.max(F.struct("h", "k")).alias("x")).first()["x"])
    return None


def _drawn(df: DataFrame, key: str, m: int, seed: int) -> Column:
    last = last_drawn(df, key, m, seed)
    if last is None:
        return F.lit(False)
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    return F.coalesce((h < last[0]) | ((h == last[0]) & (F.col(key) <= F.lit(last[1]))), F.lit(False))


def first_drawn(df: DataFrame, key: str, m: int, seed: int = 42) -> DataFrame:
    """The first m rows in hash order; rows of one key go together."""
    return df.where(_drawn(df, key, m, seed))


def disjoint(a: DataFrame, b: DataFrame, group: str) -> bool:
    """Whether two splits share no group; null groups are one."""
    other = b.select(F.col(group).alias("other_group")).distinct()
    return a.join(other, F.col(group).eqNullSafe(F.col("other_group")), "left_semi").isEmpty()


def shared_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """The groups that stand in more than one split, and in how many: empty where the splits are right."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def rank_shard(df: DataFrame, order: str, rank: int, workers: int) -> DataFrame:
    """The contiguous part of a table that one of several workers takes: ceil(n / workers) rows each, in order.

    The parts' bounds come from counts of ranges of the order column; a row's
    place is its range's start and its place in it.
    """
    placed = with_place(df, order)
    n = df.count()
    size = -(-n // workers)
    return placed.where((F.col("place") >= rank * size) & (F.col("place") < (rank + 1) * size)).drop("place")


def with_place(df: DataFrame, *order: str) -> DataFrame:
    """Adds `place`, from 0 in order, without one task for all: rows are dealt by ranges, and a range starts where those before it end.

    The ranges are written down as a column before they are counted, so both
    branches read one dealing.
    """
    d = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    d = d.withColumn("place_part", F.spark_partition_id()).withColumn("place_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    d = d.persist(StorageLevel.DISK_ONLY)  # recomputed from its input if a part is lost; ranges are drawn by a fixed seed
    sizes = sorted((r[0], r[1]) for r in d.groupBy("place_part").count().collect())  # one row a task
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    if not starts:
        return d.drop("place_part", "place_in").withColumn("place", F.lit(0).cast("long"))
    begin = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("place_part")]
    return d.withColumn("place", (begin + F.col("place_in")).cast("long")).drop("place_part", "place_in")


def greedy_folds(groups: list[tuple], folds: int, size_weight: float = 0.20, numeric_weight: float = 0.10, seed: int = 42) -> dict:
    """group -> fold: large and rare groups first, each to the fold where squared deviations from the ideal grow least.

    A group is (id, size, {label: count}, [numeric sums]). Ties go to the
    smaller, then the first fold.
    """
    labels = sorted({x for g in groups for x in g[2]}, key=lambda x: (x is not None, x))  # null first
    at = {x: i for i, x in enumerate(labels)}
    counts = np.zeros((len(groups), len(labels)))
    for i, g in enumerate(groups):
        for x, c in g[2].items():
            counts[i, at[x]] = c
    sizes = np.array([g[1] for g in groups], float)
    sums = np.array([g[3] for g in groups], float).reshape(len(groups), -1)
    total = counts.sum(0)
    rarity = (counts / np.maximum(total, 1)).sum(1)
    order = list(range(len(groups)))
    random.Random(seed).shuffle(order)
    order.sort(key=lambda i: (-sizes[i], -rarity[i], -np.count_nonzero(counts[i])))
    ideal = [(x.sum(0) / folds, w) for x, w in ((counts, 1.0), (sizes[:, None], size_weight), (sums, numeric_weight))]
    state = [np.zeros((folds, x.shape[1])) for x in (counts, sizes[:, None], sums)]
    out = {}
    for i in order:
        adds = (counts[i], sizes[i : i + 1], sums[i])
        cost = np.zeros(folds)
        for (best, w), have, add in zip(ideal, state, adds, strict=True):
            scale = np.maximum(np.abs(best), 1.0)
            # only the changed fold's term differs between choices
            cost += w * (((have + add - best) ** 2 - (have - best) ** 2) / scale).sum(1)
        fold = min(range(folds), key=lambda f: (round(float(cost[f]), 9), state[1][f, 0], f))
        for have, add in zip(state, adds, strict=True):
            have[fold] += add
        out[groups[i][0]] = fold
    return out


def stratified_folds(df: DataFrame, group: str, label: str, numeric: list[str], folds: int, seed: int = 42, max_groups: int = 200_000) -> DataFrame:
    """Adds `fold`: `greedy_folds` at every size, from one row of sums a group and label.

    Up to `max_groups` groups are placed on the driver; more are placed by the
    same rule in one task, so that the driver holds none of them. A task of
    its own is needed, as each place depends on all before.
    """
    stats = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("c"), *[F.sum(x).cast("double").alias(f"s{i}") for i, x in enumerate(numeric)])
    stats = stats.select(F.col(group).alias("g"), F.col(label).alias("l"), "c", *[f"s{i}" for i in range(len(numeric))])

    def placed(rows: Iterable[tuple]) -> dict:
        found: dict = {}
        for g, x, c, *sums in rows:
            have = found.setdefault(g, [g, 0, {}, [0.0] * len(numeric)])
            have[1] += c
            have[2][x] = c
            have[3] = [a + (b or 0.0) for a, b in zip(have[3], sums, strict=True)]
        return greedy_folds([tuple(g) for g in found.values()], folds, seed=seed)

    schema = T.StructType([T.StructField("__g", df.schema[group].dataType), T.StructField("fold", T.IntegerType())])
    if df.select(group).distinct().count() > max_groups:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = None

            def rows() -> Iterator[tuple]:
                nonlocal kind
                for batch in batches:
                    kind = batch.schema.field(0).type
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

            fold_of = placed(rows())
            if fold_of:
                yield pa.RecordBatch.from_arrays([pa.array(list(fold_of), kind), pa.array(list(fold_of.values()), pa.int32())], ["__g", "fold"])

        place = stats.repartition(1).sortWithinPartitions("g", "l").mapInArrow(run, schema)
    else:
        place = df.sparkSession.createDataFrame(list(placed(stats.orderBy("g", "l").collect()).items()), schema)
    return df.join(place, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def holdout(df: DataFrame, group: str, label: str, numeric: list[str], share: float, seed: int = 42) -> DataFrame:
    """Adds `split`: of about 1 / share folds, the one nearest to the wanted size is eval."""
    folds = max(2, round(1 / share))
    d = stratified_folds(df, group, label, numeric, folds, seed)
    sizes = {r["fold"]: r["n"] for r in d.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = sum(sizes.values()) * share
    best = min(sizes, key=lambda f: (abs(sizes[f] - want), f), default=0)
    return d.withColumn("split", F.when(F.col("fold") == best, "eval").otherwise("train")).drop("fold")


def only_official_eval(df: DataFrame, source: str, official: str = "official") -> DataFrame:
    """Rows of other sources go back to train."""
    return df.withColumn("split", F.when(F.col(source) == official, F.col("split")).otherwise("train"))


def exact_by_source(df: DataFrame, key: str, source: str, share: float, noisy_share: float = 0.5, official: str = "official", seed: int = 42) -> DataFrame:
    """Adds `split`: int(n x share) rows are eval, the wanted share of them from noisy sources as far as there are any.

    Counts of hash ranges find the last row taken on either side; the rows are
    then told by comparison.
    """
    noisy = F.col(source) != official
    counts = {r["noisy"]: r["n"] for r in df.groupBy(noisy.alias("noisy")).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = int(sum(counts.values()) * share)
    take = {True: min(counts.get(True, 0), int(want * noisy_share))}
    take[False] = min(counts.get(False, 0), want - take[True])
    chosen = F.lit(False)
    for side, m in take.items():
        own = noisy if side else ~noisy
        chosen = chosen | F.coalesce(own & _drawn(df.where(own), key, m, seed), F.lit(False))
    return df.withColumn("split", F.when(chosen, "eval").otherwise("train"))


def exact_group_holdout(df: DataFrame, group: str, want: int, seed: int = 42, max_groups: int = 200_000) -> DataFrame:
    """Adds `split`: whole groups, in hash order while they fit, make up as near to `want` eval rows as they can without passing it.

    One row a group is looked at: on the driver up to `max_groups`, and by the
    same rule in one task, batch by batch, where there are more.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n = sizes.count()
    sizes = sizes.select(F.col(group).alias("__g"), "n", draw(seed, F.col(group)).alias("h"))

    def taken(rows: Iterable[tuple], left: int) -> Iterator:
        for g, size in rows:
            if size <= left:
                left -= size
                yield g

    schema = T.StructType([T.StructField("__g", df.schema[group].dataType)])
    if n > max_groups:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = want
            for batch in batches:
                sizes_of = batch.column(1).to_pylist()
                keep = list(taken(enumerate(sizes_of), left))
                left -= sum(sizes_of[i] for i in keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], ["__g"])

        chosen = sizes.repartition(1).sortWithinPartitions("h", "__g").select("__g", "n").mapInArrow(run, schema)
    else:
        groups = list(taken(((r["__g"], r["n"]) for r in sizes.orderBy("h", "__g").limit(n).collect()), want))
        if not groups:
            return df.withColumn("split", F.lit("train"))
        chosen = df.sparkSession.createDataFrame([(g,) for g in groups], schema)
    chosen = chosen.withColumn("__e", F.lit(True))
    d = df.join(chosen, F.col(group).eqNullSafe(F.col("__g")), "left")
    return d.withColumn("split", F.when(F.col("__e"), "eval").otherwise("train")).drop("__g", "__e")
