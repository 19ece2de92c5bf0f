"""Training sets assembled from tables: preference pairs, instructions, masked names, synthetic pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import squeeze
from quern.operators.joins import unambiguous
from quern.operators.windows import bucket_number


def preference_pairs(chosen: DataFrame, rejected: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pairs of a chosen and a rejected text for keys that are unambiguous on both sides, where the texts differ."""
    def clean(d: DataFrame, name: str) -> DataFrame:
        d = d.select(*[squeeze(F.col(k).cast("string")).alias(k) for k in keys], squeeze(F.col(text)).alias(text))
        d = d.where((F.col(text) != "") & (F.col(keys[0]) != ""))
        return unambiguous(d, keys, text).withColumnRenamed(text, name)

    return clean(chosen, "chosen").join(clean(rejected, "rejected"), keys).where("chosen <> rejected")


def shifted_negatives(df: DataFrame, order: str, text: str, rows: int = 4096) -> DataFrame:
    """Adds `rejected`: another row's text. Rows go round in a circle within buckets of `rows` rows in order, of which there are as many as the table needs.

    A text equal to the row's own gives way to the one after it. A row of a
    bucket of its own, or among equals, gets none (null).
    """
    w = Window.partitionBy("__b").orderBy(order)
    d = bucket_number(df, order, rows).withColumnRenamed("bucket", "__b")
    # the first two of a bucket follow its last
    heads = d.withColumn("__i", F.row_number().over(w)).where("__i <= 2").groupBy("__b").agg(F.max(F.when(F.col("__i") == 1, F.col(text))).alias("__h1"), F.max(F.when(F.col("__i") == 2, F.col(text))).alias("__h2")).withColumnRenamed("__b", "__c")
    d = d.withColumns({"__n1": F.lead(text, 1).over(w), "__n2": F.lead(text, 2).over(w)}).join(heads, F.col("__b") == F.col("__c"))
    one = F.coalesce("__n1", "__h1")
    two = F.when(F.col("__n1").isNull(), F.col("__h2")).otherwise(F.coalesce("__n2", "__h1"))
    other = F.when(one != F.col(text), one).when(two != F.col(text), two)
    return d.withColumn("rejected", other).drop("__b", "__c", "__n1", "__n2", "__h1", "__h2")


def messages(system: str, user: Column, assistant: Column) -> Column:
    """A chat record as JSON."""
    return F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user), ("assistant", assistant))]).alias("messages")))


def task_mix(parts: list[tuple[DataFrame, float]], key: str, total: int, seed: int = 42) -> DataFrame:
    """At most total x share rows of each part, by hash order, in one table."""
    from quern.operators.splits import first_drawn

    out = None
    for d, share in parts:
        most = int(total * share)
        d = first_drawn(d, key, most, seed) if d.count() > most else d
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def mask_names(source: Column, target: Column, names: Column, most: int = 20) -> Column:
    """struct<source,target,held>: names of a map source -> target found on both sides become <e0>, <e1>, ..., the longest first."""
    both = F.filter(F.map_entries(names), lambda e: source.contains(e["key"]) & target.contains(e["value"]))
    order = F.slice(F.array_sort(F.transform(both, lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), 1, most)

    def swap(text: Column, side: str) -> Column:
        start = F.struct(text.alias("t"), F.lit(0).alias("i"))
        return F.aggregate(order, start, lambda a, e: F.struct(F.replace(a["t"], e[side], F.concat(F.lit("<e"), a["i"].cast("string"), F.lit(">"))).alias("t"), (a["i"] + 1).alias("i")), lambda a: a["t"])

    return F.struct(swap(source, "key").alias("source"), swap(target, "value").alias("target"), F.transform(order, lambda e: e["value"]).alias("held"))


def unmask_names(text: Column, held: Column) -> Column:
    start = F.struct(text.alias("t"), F.lit(0).alias("i"))
    return F.aggregate(held, start, lambda a, v: F.struct(F.replace(a["t"], F.concat(F.lit("<e"), a["i"].cast("string"), F.lit(">")), v).alias("t"), (a["i"] + 1).alias("i")), lambda a: a["t"])


#: Sixths of a unit by sign, and sixty shekels to a mina.
SIXTHS = {"": 0, "⅙": 1, "⅓": 2, "½": 3, "⅔": 4, "⅚": 5}


def sixths(whole: Column, sign: Column) -> Column:
    """A mixed number in sixths, in whole-number arithmetic."""
    return whole * 6 + F.element_at(F.create_map(*[F.lit(x) for kv in SIXTHS.items() for x in kv]), sign)


def quantity(total: Column) -> Column:
    """Sixths as a whole number and a sign."""
    sign = F.element_at(F.create_map(*[F.lit(x) for k, v in SIXTHS.items() for x in (v, k)]), F.pmod(total, F.lit(6)).cast("int"))
    return F.trim(F.concat_ws(" ", F.when(total >= 6, F.floor(total / 6).cast("string")), sign))


def weight_pairs(spark, rows: int, seed: int = 42) -> DataFrame:
    """Synthetic pairs of a weight of silver in minas and shekels and its total in shekels."""
    def pick(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + salt), "id"), F.lit(n)).cast("int")

    signs = F.array(*[F.lit(s) for s in ("", "⅓", "½", "⅔", "⅚")])
    d = spark.range(rows).select("id", (pick(10, 1) + 1).alias("mina"), F.element_at(signs, pick(5, 2) + 1).alias("part"), (pick(59, 3) + 1).alias("shekel"))
    total = sixths(F.col("mina"), F.col("part")) * 60 + F.col("shekel") * 6
    source = F.concat(quantity(sixths(F.col("mina"), F.col("part"))), F.lit(" ma-na "), F.col("shekel").cast("string"), F.lit(" GÍN KÙ.BABBAR"))
    return d.select("id", source.alias("source_text"), F.concat(quantity(total), F.when(total == 6, " shekel").otherwise(" shekels"), F.lit(" of silver")).alias("target_text"))


#: Spellings of the months and their numbers, in the calendar's order.
MONTHS = (
    ("bé-el-tí-é.gal-lim", 1), ("be-el-té-é.gal-lim", 1),
    ("ša sá-ra-tim", 2),
    ("ke-na-tim", 3),
    ("ma-hu-ur-dingir", 4), ("ma-ḫu-ur-i-lí", 4),
    ("áb-ša-ra-ni", 5), ("áb ša-ra-ni", 5), ("áb-ša-ra-nu", 5),
    ("hu-bu-ur", 6),
    ("ṣí-ip-im", 7),
    ("qá-ra-a-tí", 8), ("qá-ra-a-tim", 8),
    ("kán-wa-ar-ta", 9), ("kán-wa-ar-ta-an", 9), ("kán-wár-ta", 9), ("kán-mar-ta", 9), ("kán-bar-ta", 9), ("kà-an-ma-ar-ta", 9),
    ("té-i-na-tim", 10),
    ("ku-zal-li", 11), ("ku-zal-lu", 11),
    ("a-lá-na-tum", 12), ("a-lá-na-tim", 12),
)


def _months() -> Column:
    return F.array(*[F.struct(F.lit(m).alias("name"), F.lit(n).alias("n")) for m, n in MONTHS])


def month_pairs(spark, rows: int, seed: int = 42) -> DataFrame:
    """Synthetic pairs of a month's formula and its number."""
    i = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(MONTHS))).cast("int")
    d = spark.range(rows).withColumn("m", F.element_at(_months(), i + 1))
    return d.select("id", F.concat(F.lit("ITU.KAM "), "m.name").alias("source_text"), F.concat(F.lit("Month "), "m.n").alias("target_text"))


def month_hints(text: Column) -> Column:
    """The text, and after it the number of each month it names, unless it has such a note."""
    found = F.transform(F.filter(_months(), lambda x: F.lower(text).contains(x["name"])), lambda x: F.concat(x["name"], F.lit("=month "), x["n"].cast("string")))
    return F.when((F.size(found) > 0) & ~text.contains("## MONTH:"), F.concat(text, F.lit(" ## MONTH: "), F.array_join(found, "; "))).otherwise(text)


def vocabulary_pairs(words: DataFrame, word: str, gloss: str, frames: list[tuple[str, str]], each: int = 2, seed: int = 42) -> DataFrame:
    """Each word in `each` of the frames, pairs of texts with {} for the word and its gloss; chosen by a hash of the word."""
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(i).alias("i")) for i, (s, t) in enumerate(frames)])
    order = F.array_sort(F.transform(table, lambda f: F.struct(F.xxhash64(F.lit(seed), F.col(word), f["i"]).alias("h"), f["s"].alias("s"), f["t"].alias("t"))))
    d = words.select(word, gloss, F.explode(F.slice(order, 1, each)).alias("f"))
    return d.select(word, F.replace("f.s", F.lit("{}"), F.col(word)).alias("source_text"), F.replace("f.t", F.lit("{}"), F.col(gloss)).alias("target_text"))


def scored_candidates(df: DataFrame, candidates: str, reference: str, least: int = 2, bleu: float = 0.5) -> DataFrame:
    """Candidates, trimmed and distinct, with the reference among them, and a mixed score of each; rows with fewer than `least` go."""
    import pandas as pd

    from quern.functions.metrics import sentence_bleu, sentence_chrf

    def run(arrays, references):
        return pd.Series([[bleu * sentence_bleu(c, r or "") + (1 - bleu) * sentence_chrf(c, r or "") for c in a] for a, r in zip(arrays, references, strict=True)])

    udf = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)
    trimmed = F.filter(F.transform(candidates, lambda x: F.trim(x)), lambda x: x != "")
    d = df.withColumn(candidates, F.array_distinct(F.concat(trimmed, F.array(F.trim(reference)))))
    d = d.where((F.size(candidates) >= least) & (F.trim(reference) != ""))
    return d.withColumn("scores", udf(candidates, reference))
