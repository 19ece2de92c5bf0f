"""Translation metrics from their published definitions.

BLEU and chrF are computed from sufficient statistics, a few sums a row, so
that a corpus score is an ordinary aggregation: rows add up in any order, on
any number of tasks, and the closed form is applied to the sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAR_ORDER, WORD_ORDER, BETA, BLEU_ORDER = 6, 2, 2, 4
N_CHRF, N_BLEU = 3 * (CHAR_ORDER + WORD_ORDER), 2 + 2 * BLEU_ORDER
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_BLEU_RULES = ((re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))


def bleu_tokens(text: str) -> list[str]:
    """The common tokenisation of machine-translation evaluations: punctuation apart, but not within numbers."""
    t = f" {text} "
    for pattern, replacement in _BLEU_RULES:
        t = pattern.sub(replacement, t)
    return t.split()


def chrf_words(text: str) -> list[str]:
    """Words with one leading or trailing punctuation mark apart."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) if not isinstance(items, str) else items[i : i + n] for i in range(len(items) - n + 1))


def chrf_stats(hypothesis: str, reference: str) -> list[int]:
    """For each character and word order: n-grams of the hypothesis, of the reference, and shared."""
    out: list[int] = []
    for h, r, orders in ((re.sub(r"\s+", "", hypothesis), re.sub(r"\s+", "", reference), CHAR_ORDER), (chrf_words(hypothesis), chrf_words(reference), WORD_ORDER)):
        for n in range(1, orders + 1):
            a, b = _grams(h, n), _grams(r, n)
            out += [sum(a.values()), sum(b.values()), sum((a & b).values())]
    return out


def chrf_score(stats) -> float:
    """chrF with beta 2, averaged over the orders that both sides have; 0 to 100."""
    precision = recall = 0.0
    orders = 0
    for i in range(0, len(stats), 3):
        h, r, m = stats[i : i + 3]
        if h > 0 and r > 0:
            precision, recall, orders = precision + m / h, recall + m / r, orders + 1
    if not orders or precision + recall == 0:
        return 0.0
    precision, recall = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * precision * recall / (BETA**2 * precision + recall)


def bleu_stats(hypothesis: str, reference: str) -> list[int]:
    """Lengths of both, and for each order the shared and all n-grams of the hypothesis."""
    h, r = bleu_tokens(hypothesis), bleu_tokens(reference)
    out = [len(h), len(r)]
    for n in range(1, BLEU_ORDER + 1):
        a, b = _grams(h, n), _grams(r, n)
        out += [sum((a & b).values()), sum(a.values())]
    return out


def bleu_score(stats, effective_order: bool = True) -> float:
    """BLEU with exponential smoothing of empty orders; effective_order leaves out those the hypothesis is too short for."""
    h, r = stats[:2]
    if h == 0 or stats[2] == 0:
        return 0.0
    smooth, logs, orders = 1.0, 0.0, 0
    for n in range(BLEU_ORDER):
        match, total = stats[2 + 2 * n : 4 + 2 * n]
        if total == 0:
            break
        orders = n + 1
        if match == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * total))
        else:
            logs += math.log(match / total)
    if not effective_order and orders < BLEU_ORDER:
        return 0.0
    brevity = 1.0 if h >= r else math.exp(1 - r / h)
    return 100 * brevity * math.exp(logs / (orders if effective_order else BLEU_ORDER))


def sentence_chrf(hypothesis: str, reference: str) -> float:
    return chrf_score(chrf_stats(hypothesis, reference))


def sentence_bleu(hypothesis: str, reference: str) -> float:
    return bleu_score(bleu_stats(hypothesis, reference))


@F.pandas_udf(T.ArrayType(T.LongType()))
def pair_stats(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """The statistics of chrF and then BLEU of each pair; null texts are empty."""
    return pd.Series([chrf_stats(h or "", r or "") + bleu_stats(h or "", r or "") for h, r in zip(hypothesis, reference, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("bleu", "chrf", "geometric")]))
def corpus_scores(stats: pd.Series) -> pd.DataFrame:
    """Corpus scores of summed statistics; the geometric mean counts neither below 0.01."""
    rows = []
    for s in stats:
        chrf, bleu = chrf_score(s[:N_CHRF]), bleu_score(s[N_CHRF:], effective_order=False)
        rows.append((bleu, chrf, math.sqrt(max(bleu, 0.01) * max(chrf, 0.01))))
    return pd.DataFrame(rows, columns=["bleu", "chrf", "geometric"])


def corpus_metrics(df: DataFrame, hypothesis: str, reference: str, *groups: str) -> DataFrame:
    """Corpus BLEU, chrF and their geometric mean over all rows, or by group: one sum for each statistic."""
    d = df.select(*groups, pair_stats(F.coalesce(hypothesis, F.lit("")), F.coalesce(reference, F.lit(""))).alias("s"))
    sums = F.array(*[F.sum(F.col("s")[i]) for i in range(N_CHRF + N_BLEU)])
    g = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), sums.alias("s")).where("n > 0")
    return g.select(*groups, "n", corpus_scores("s").alias("x")).select(*groups, "n", "x.*")


def repetition_penalty(text: Column, word_floor: float = 0.6, pair_floor: float = 0.7, word_scale: float = 20.0, pair_scale: float = 20.0) -> Column:
    """What a text loses for few distinct words and few distinct neighbouring pairs."""
    from quern.functions.text import let, words

    def distinct(xs: Column) -> Column:
        return F.size(F.array_distinct(xs)) / F.size(xs)

    def loss(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws("\u0001", F.slice(w, i, 2)))
        return F.when(F.size(w) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), word_floor - distinct(w)) * word_scale + F.greatest(F.lit(0.0), pair_floor - let(pairs, distinct)) * pair_scale)

    return let(words(text), loss)


def length_penalty(hypothesis: Column, reference: Column, low: float = 0.85, high: float = 1.25, low_scale: float = 80.0, high_scale: float = 40.0) -> Column:
    from quern.functions.text import word_count

    r = F.greatest(word_count(hypothesis), F.lit(1)) / F.greatest(word_count(reference), F.lit(1))
    under, over = F.greatest(F.lit(0.0), low - r), F.greatest(F.lit(0.0), r - high)
    return low_scale * under * under + high_scale * over * over


def coverage_penalty(hypothesis: Column, reference: Column, floor: float = 0.8, scale: float = 50.0) -> Column:
    from quern.functions.text import word_count

    r = F.greatest(word_count(hypothesis), F.lit(1)) / F.greatest(word_count(reference), F.lit(1))
    return F.when(r >= floor, 0.0).otherwise((floor - r) * scale)


def number_tokens(text: Column) -> Column:
    """Mixed numbers, fractions and whole numbers of a text, without inner spaces; mixed ones first."""
    signs = "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"
    mixed = F.regexp_extract_all(text, F.lit(rf"(\d+\s*[{signs}])"), 1)
    rest = F.regexp_replace(text, rf"\d+\s*[{signs}]", " ")
    simple = F.regexp_extract_all(rest, F.lit(rf"(\d+/\d+|\d+|[{signs}])"), 1)
    return F.transform(F.concat(mixed, simple), lambda x: F.regexp_replace(x, r"\s+", ""))


def match_share(reference: Column, hypothesis: Column) -> Column:
    """The share of the reference's items that the hypothesis has, counting repeats; 0 for none."""
    from quern.operators.dedup import multiset_overlap

    return F.when(F.size(reference) == 0, 0.0).otherwise(multiset_overlap(reference, hypothesis) / F.size(reference))


def median(values: list[float]) -> float:
    return float(np.median(values)) if values else 0.0
