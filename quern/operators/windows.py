"""Order-sensitive operators; the order is always a column, never the partition's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantile_buckets(df: DataFrame, value: str, order: str, bins: int, prefix: str) -> DataFrame:
    """Adds `<value>_bucket`: the row's rank (ties in order) in `bins` parts of equal width, as prefix_k; one distinct value gives prefix_0.

    A global rank in one window would go through one task; the place in the
    whole order comes from ranges of the value instead.
    """
    from quern.operators.splits import with_place

    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    d = with_place(df.withColumn("__v", v), "__v", order)
    some = d.agg(F.count_distinct("__v").alias("__u"), F.count(F.lit(1)).alias("__n"))
    d = d.crossJoin(F.broadcast(some))  # one row
    q = F.least(F.lit(bins), F.col("__u"))
    rank = F.col("place") + 1
    # ceil((rank - 1) q / (n - 1)) - 1 in whole numbers
    part = F.greatest(F.lit(0), F.floor(((rank - 1) * q + F.col("__n") - 2) / F.greatest(F.col("__n") - 1, F.lit(1))) - 1)
    code = F.when((F.col("__u") <= 1) | (F.lit(bins) <= 1), 0).otherwise(part.cast("int"))
    return d.withColumn(f"{value}_bucket", F.concat(F.lit(f"{prefix}_"), code)).drop("__v", "place", "__n", "__u")


def next_start(df: DataFrame, group: str, order: str, start: str, end: Column) -> DataFrame:
    """Adds `stop`: where the group's next row starts, or the end."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("stop", F.coalesce(F.lead(start).over(w), end))


def sliding_rows(df: DataFrame, group: str, order: str, text: str, low: int = 2, high: int = 4, max_chars: int = 260) -> DataFrame:
    """Every run of `low` to `high` neighbouring rows whose texts together are short enough: group, first, size, text."""
    out = None
    for n in range(low, high + 1):
        w = Window.partitionBy(group).orderBy(order).rowsBetween(0, n - 1)
        d = df.select(group, F.col(order).alias("first"), F.collect_list(F.coalesce(text, F.lit(""))).over(w).alias("p")).where(F.size("p") == n)
        d = d.select(group, "first", F.lit(n).alias("size"), F.array_join("p", " ").alias(text), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).alias("__c")).where(F.col("__c") <= max_chars).drop("__c")
        out = d if out is None else out.unionByName(d)
    return out


def line_groups(df: DataFrame, page: str, y: str, x: str, tolerance: float) -> DataFrame:
    """Adds `line`: a new one wherever a box is further down than the tolerance from the one before."""
    w = Window.partitionBy(page).orderBy(y, x)
    d = df.withColumn("__new", F.when(F.abs(F.col(y) - F.lag(y).over(w)) > tolerance, 1).otherwise(0))
    return d.withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_index(df: DataFrame, group: str, order: str, name: str = "index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def token_budget_batches(lengths: list[tuple[int, int]], budget: int, most: int | None = None) -> list[int]:
    """The batch of each (source, target) length in turn: a batch closes before count x (longest source + longest target) passes the budget."""
    out, batch, n, s, t = [], 0, 0, 0, 0
    for a, b in lengths:
        if n and ((n + 1) * (max(s, a) + max(t, b)) > budget or most is not None and n >= most):
            batch, n, s, t = batch + 1, 0, 0, 0
        n, s, t = n + 1, max(s, a), max(t, b)
        out.append(batch)
    return out


def batched(df: DataFrame, bucket: str, order: str, source_len: str, target_len: str, budget: int) -> DataFrame:
    """Adds `batch` within each bucket, by a fold over the bucket's rows in order; buckets are sized by the caller."""
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(batch=token_budget_batches(list(zip(pdf[source_len], pdf[target_len], strict=True)), budget))

    return df.groupBy(bucket).applyInPandas(run, schema)


def bucket_number(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Adds `bucket`: runs of `rows` rows in order, so that there are as many as the table needs."""
    from quern.operators.splits import with_place

    return with_place(df, order).withColumn("bucket", F.floor(F.col("place") / rows)).drop("place")


def shuffled_buckets(df: DataFrame, key: str, source_len: str, target_len: str, epoch: int = 0, seed: int = 42, rows: int = 128) -> DataFrame:
    """Adds `place`: rows in a drawn order, cut into buckets of `rows`, longest first within a bucket; another epoch draws another order."""
    from quern.operators.splits import with_place

    d = df.withColumn("__d", F.xxhash64(F.lit(seed + epoch), F.col(key)))
    d = with_place(d, "__d", key).withColumn("bucket", F.floor(F.col("place") / rows))
    longest = F.greatest(source_len, target_len)
    w = Window.partitionBy("bucket").orderBy(longest.desc(), (F.col(source_len) + F.col(target_len)).desc(), "__d", key)
    return d.withColumn("place", F.col("bucket") * rows + F.row_number().over(w) - 1).drop("__d")


def curriculum(df: DataFrame, source: str, target: str, order: str, hardest_first: bool = False) -> DataFrame:
    """Rows by the length of both texts, short ones first, or, to find the limits of memory, the other way round; ties keep their order."""
    size = F.length(F.coalesce(source, F.lit(""))) + F.length(F.coalesce(target, F.lit("")))
    return df.orderBy(size.desc() if hardest_first else size, order)


def first_changed(df: DataFrame, before: Column, after: Column, order: str, within: int = 800) -> DataFrame:
    """The first row, of the first `within`, that a step changes."""
    return df.orderBy(order).limit(within).where(~before.eqNullSafe(after)).orderBy(order).limit(1)


def budget_prefix(items: Column, size_of, budget: int, most: int) -> Column:
    """The items of an array in order while their sizes fit the budget, at most `most`; the first that does not fit ends it."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a, x):
        full = a["full"] | (a["used"] + size_of(x) > budget) | (F.size(a["kept"]) >= most)
        return F.struct(F.when(full, a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"), F.when(full, a["used"]).otherwise(a["used"] + size_of(x)).alias("used"), full.alias("full"))

    return F.aggregate(items, start, step, lambda a: a["kept"])
