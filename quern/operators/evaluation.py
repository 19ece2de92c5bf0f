"""Error classes and rates of predictions against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.features import entities, numbers
from quern.functions.text import let, word_count, words

_NUMBER = r"\b(\d+(?:\.\d+)?(?:/\d+)?)\b"
_TAG = r"(\[\[[EN]\d+\]\])"


def _set(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))


def repeats(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Whether a phrase of such a length follows itself."""
    def of(n: int):
        return lambda w: F.exists(F.sequence(F.lit(1), F.greatest(F.size(w) - 2 * n + 1, F.lit(1))), lambda i: (F.size(w) >= 2 * n) & (F.slice(w, i, n) == F.slice(w, i + n, n)))

    return let(words(text), lambda w: (F.size(w) >= 6) & (of(sizes[0])(w) | of(sizes[1])(w) | of(sizes[2])(w)))


def error_flags(df: DataFrame, prediction: str, reference: str, names: list[str] | None = None) -> DataFrame:
    """Adds a flag for each class of error: names, numbers, repeats, truncation, gaps, tags."""
    p, r = F.coalesce(prediction, F.lit("")), F.coalesce(reference, F.lit(""))
    rn, pn, rt, pt = _set(r, _NUMBER), _set(p, _NUMBER), _set(r, _TAG), _set(p, _TAG)

    def named(text: Column) -> Column:
        return F.array_intersect(F.transform(words(text), lambda w: F.regexp_replace(w, r"^[.,;:?!()\[\]{}'\"]+|[.,;:?!()\[\]{}'\"]+$", "")), F.array(*map(F.lit, names or [])).cast("array<string>"))

    return df.withColumns({
        "err_proper_noun": F.size(F.array_except(named(r), named(p))) > 0,
        "err_number": (F.size(rn) > 0) & (rn != pn),
        "err_repeated": repeats(p),
        "err_truncated": (F.length(p) < 0.5 * F.length(r)) & (F.length(r) > 50),
        "err_gap": F.lower(r).contains("<gap>") & (p.contains("...") | F.lower(p).contains("xxx")),
        "err_tag": rt != pt,
    })


def error_summary(flags: DataFrame, key: str) -> DataFrame:
    """Each class's count, share in percent and first example, from one pass."""
    names = [c for c in flags.columns if c.startswith("err_")]
    long = flags.select(key, F.explode(F.array(*[F.struct(F.lit(c[4:]).alias("error"), F.col(c).alias("hit")) for c in names])).alias("x")).select(key, "x.*")
    g = long.groupBy("error").agg(F.count_if("hit").alias("n"), F.count(F.lit(1)).alias("all"), F.min(F.when(F.col("hit"), F.col(key))).alias("first"))
    return g.select("error", "n", (100.0 * F.col("n") / F.greatest("all", F.lit(1))).alias("percent"), "first")


def rates(df: DataFrame, prediction: str, reference: str, source: str, *groups: str) -> DataFrame:
    """Length ratio rates, and exact matches of the sets of numbers and entities (1 where no reference has any)."""
    p, r = F.coalesce(prediction, F.lit("")), F.coalesce(reference, F.lit(""))
    ratio = word_count(p) / F.greatest(word_count(r), F.lit(1))

    def exact(of) -> Column:
        a, b = F.array_sort(F.array_distinct(of(r))), F.array_sort(F.array_distinct(of(p)))
        return F.when(F.size(a) > 0, (a == b).cast("double"))

    d = df.select(*groups, ratio.alias("x"), exact(numbers).alias("num"), exact(entities).alias("ent"), (word_count(p) < 2).alias("near_empty"), F.lower(F.coalesce(source, F.lit(""))).contains("<gap>").alias("gap"))
    return d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("length_ratio"), F.avg((F.col("x") < 0.8).cast("double")).alias("under"), F.avg((F.col("x") > 1.35).cast("double")).alias("over"),
        F.avg(F.col("near_empty").cast("double")).alias("near_empty"), F.coalesce(F.avg("num"), F.lit(1.0)).alias("number_match"), F.coalesce(F.avg("ent"), F.lit(1.0)).alias("entity_match"),
        F.count_if("gap").alias("gap_cases"),
    )


def worst(df: DataFrame, score: str, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(score, order).limit(n)


def missed_entities(df: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """(entity, n, example): names of references that their predictions lack, whatever the case."""
    lower = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.lower(x)))
    d = df.select(key, F.explode(F.array_except(lower(entities(F.col(reference))), lower(entities(F.col(prediction))))).alias("entity"))
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))


def batch_fill(batches: DataFrame, batch: str, source_len: str, target_len: str) -> DataFrame:
    """How full batches are: their number, mean rows, and mean share of padded places that hold tokens."""
    g = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(source_len) + F.col(target_len)).alias("used"), (F.max(source_len) + F.max(target_len)).alias("widest"))
    return g.agg(F.count(F.lit(1)).alias("batches"), F.avg("rows").alias("mean_rows"), F.avg(F.col("used") / F.greatest(F.col("rows") * F.col("widest"), F.lit(1))).alias("fill"))
