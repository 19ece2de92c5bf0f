"""Repair of encoding damage, and corrections that a vocabulary confirms."""

from __future__ import annotations

import difflib
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import fold, squeeze, words
from quern.operators.joins import last_by, nearest_word

_LOW = "a-záàéèíìúù"
#: Marks of a damaged row, and the repairs that are safe without a vocabulary.
DAMAGE = ("„", "…", "mup-p", "me-+e")
REPAIRS = [("„", "-"), ("-{2,}", "-"), ("…", ""), (r"\bmup-p", "ṭup-p"), (rf"(?<=[{_LOW}])-\+(?=[{_LOW}])", "-h"), (rf"(?<![{_LOW}A-ZÁÀÉÈÍÌÚÙ])aa(?![{_LOW}A-Z])", "ša")]


def is_damaged(text: Column) -> Column:
    out = F.lit(False)
    for m in DAMAGE:
        out = out | text.contains(m)
    return out


def repaired(text: Column) -> Column:
    return F.when(is_damaged(text), squeeze(fold(text, REPAIRS))).otherwise(text)


def vocabulary(texts: DataFrame, text: str, lexicon: DataFrame, form: str) -> DataFrame:
    """(word, freq): words of the texts without punctuation and numbers, and forms of the lexicon that they lack, once each."""
    w = F.transform(words(F.regexp_replace(text, ":", " ")), lambda x: F.regexp_replace(x, r"^[.,;!?()\[\]{}\"' ]+|[.,;!?()\[\]{}\"' ]+$", ""))
    counts = texts.select(F.explode(w).alias("word")).where("word <> '' AND NOT word RLIKE '^[0-9]+[.,/]?[0-9]*$'").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    more = lexicon.select(F.trim(form).alias("word")).where("word <> ''").distinct()
    known = counts.select(F.col("word").alias("__w"))
    return counts.unionByName(more.join(known, F.col("word") == F.col("__w"), "left_anti").withColumn("freq", F.lit(1).cast("long")))


def swaps(token: str, wrong: str = "a", right: str = "š") -> list[str]:
    """The token with one letter swapped back, two (of at most 8 places) or three (of at most 6)."""
    at = [i for i, c in enumerate(token) if c == wrong]
    out = []
    for n, most in ((1, len(at)), (2, 8), (3, 6)):
        if len(at) <= most:
            for places in itertools.combinations(at, n):
                chars = list(token)
                for p in places:
                    chars[p] = right
                out.append("".join(chars))
    return out


def swap_corrections(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, corrected, freq): unknown tokens whose letters swapped back make a known word, the most frequent one.

    Candidates meet the vocabulary by an equi-join.
    """

    @F.pandas_udf("array<string>")
    def candidates(t: pd.Series) -> pd.Series:
        return t.map(swaps)

    v = vocab.select(F.col("word").alias("w"), F.col("freq").alias("f"))
    unknown = tokens.select("token").distinct().join(v, F.col("token") == F.col("w"), "left_anti")
    hit = unknown.select("token", F.explode(candidates("token")).alias("c")).join(v, F.col("c") == F.col("w"))
    return hit.groupBy("token").agg(F.min_by(F.struct("w", "f"), F.struct(-F.col("f"), "w")).alias("b")).select("token", F.col("b.w").alias("corrected"), F.col("b.f").alias("freq"))


def corrected(df: DataFrame, key: str, text: str, vocab: DataFrame, most: int = 1, least: int = 4) -> DataFrame:
    """(key, text, corrections): each unknown word by a swap, else by its nearest word within `most` edits if it is long enough."""
    d = df.select(key, repaired(F.col(text)).alias("t"))
    tokens = d.select(key, F.posexplode(words(F.col("t"))).alias("i", "token"))
    bare = tokens.select(F.col("token")).where("NOT token RLIKE '[()\\\\[\\\\]{}]' AND NOT token RLIKE '^[0-9]+[.,/]?[0-9]*$'").distinct()
    by_swap = swap_corrections(bare, vocab).select("token", "corrected", F.lit("swap").alias("method"))
    v = vocab.select(F.col("word").alias("w"))
    rest = bare.join(v, F.col("token") == F.col("w"), "left_anti").join(by_swap.select(F.col("token").alias("s")), F.col("token") == F.col("s"), "left_anti").where(F.length("token") >= least)
    fixes = by_swap.unionByName(nearest_word(rest, vocab, most=most).select("token", F.col("word").alias("corrected"), F.lit("edit_distance").alias("method"))) if most else by_swap
    fixes = fixes.select(F.col("token").alias("__t"), "corrected", "method")
    j = tokens.join(fixes, F.col("token") == F.col("__t"), "left")
    parts = F.array_sort(F.collect_list(F.struct("i", F.coalesce("corrected", "token").alias("w"), "token", "method")))
    g = j.groupBy(key).agg(parts.alias("p"))
    g = g.select(F.col(key).alias("__k"), F.array_join(F.transform("p", lambda x: x["w"]), " ").alias(text), F.transform(F.filter("p", lambda x: x["method"].isNotNull()), lambda x: F.struct(x["token"].alias("original"), x["w"].alias("corrected"), x["method"].alias("method"))).alias("corrections"))
    return df.select(key).distinct().join(g, F.col(key) == F.col("__k"), "left").select(key, F.coalesce(text, F.lit("")).alias(text), "corrections")


def with_marks(now: str, before: str, mark: str = "'") -> str:
    """Words that differ from the older version by the mark alone get its spelling."""
    a, b = now.split(), before.split()
    bare = [[w.replace(mark, "") for w in x] for x in (a, b)]
    if bare[0] == bare[1]:  # what the diff would find, in linear time
        return " ".join(b)
    for tag, i1, i2, j1, _ in difflib.SequenceMatcher(None, *bare).get_opcodes():
        if tag == "equal":
            a[i1:i2] = b[j1 : j1 + i2 - i1]
    return " ".join(a)


def restore_marks(current: DataFrame, older: DataFrame, key: str, text: str, order: Column, mark: str = "'") -> DataFrame:
    """Apostrophes that a later version lost, from the older one; word by word, all else stays."""

    @F.pandas_udf("string")
    def run(now: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([x if not y or mark not in y or x == y else with_marks(x or "", y, mark) for x, y in zip(now, before, strict=True)])

    o = last_by(older.select(key, text, order.alias("__ord")), [key], [F.col("__ord")]).select(F.col(key).alias("__key"), F.col(text).alias("__old"))
    d = current.join(o, F.col(key) == F.col("__key"), "left")
    return d.withColumn(text, run(F.trim(text), F.trim("__old"))).select(*current.columns)


def slash_alternatives(text: Column, table: list[tuple[str, str]]) -> Column:
    """A user's table of alternatives, then slashes that stand in no fraction go."""
    for old, new in table:
        text = F.replace(text, F.lit(old), F.lit(new))
    return fold(text, [(r"\b(\d+)\s*/\s*(\d+)\b", "$1/$2"), (r"(?<!\d)/(?!\d)", " ")])


def fuzzy_names(text: str, names: list[str], threshold: float = 0.85) -> str:
    """Capitalised words that are no name become the name they are most like, above the threshold; 1 turns this off."""
    if threshold >= 1:
        return text
    known = set(names)
    out = []
    for w in text.split(" "):
        core = w.strip(".,;:!?()'\"")
        if core[:1].isupper() and len(core) > 3 and core not in known:
            near = [(difflib.SequenceMatcher(None, core, n).ratio(), n) for n in names if abs(len(n) - len(core)) <= 3]
            score, name = max(near, default=(0.0, ""), key=lambda x: x[0])
            if score >= threshold:
                w = w.replace(core, name)
        out.append(w)
    return " ".join(out)
