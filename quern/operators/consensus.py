"""Consensus choice among candidates: the one most like all others."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.metrics import median, sentence_bleu, sentence_chrf


def _jaccard(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return 100.0 if not x and not y else 100.0 * len(x & y) / len(x | y)


def choose(candidates: list[str], metric: str = "weighted", pool: int | None = None, weights: tuple[float, float, float, float] = (0.55, 0.25, 0.20, 0.10)) -> tuple[str, float]:
    """(text, score): the mean similarity to the others decides, the first wins ties.

    `weighted` mixes chrF, BLEU and word Jaccard and adds a bonus for a length
    near the median; `geom`, `chrf` and `bleu` use one measure. A single
    distinct candidate scores 100, none gives an empty text and 0.
    """
    if not candidates:
        return "", 0.0
    distinct = list(dict.fromkeys(c.strip() for c in candidates if c and c.strip()))[:pool]
    if len(distinct) < 2:
        return (distinct or candidates)[0], 100.0
    c, b, j, bonus = weights
    alike = {
        "weighted": lambda x, y: (c * sentence_chrf(x, y) + b * sentence_bleu(x, y) + j * _jaccard(x, y)) / (c + b + j),
        "geom": lambda x, y: math.sqrt(max(sentence_chrf(x, y), 0.0) * max(sentence_bleu(x, y), 0.0)),
        "chrf": sentence_chrf,
        "bleu": sentence_bleu,
    }[metric]
    sizes = [len(x.split()) for x in distinct]
    mid = median(sizes)
    spread = max(0.4 * mid, 5.0)
    scores = []
    for i, x in enumerate(distinct):
        mean = sum(alike(x, y) for k, y in enumerate(distinct) if k != i) / (len(distinct) - 1)
        scores.append(mean + (bonus * 100.0 * math.exp(-0.5 * ((sizes[i] - mid) / spread) ** 2) if metric == "weighted" else 0.0))
    best = max(range(len(scores)), key=scores.__getitem__)
    return distinct[best], scores[best]


def chosen(candidates: Column, metric: str = "weighted", pool: int | None = None) -> Column:
    """struct<text,score> of the choice in an array of candidates."""

    @F.pandas_udf("struct<text:string,score:double>")
    def run(arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([choose(list(a) if a is not None else [], metric, pool) for a in arrays], columns=["text", "score"])

    return run(candidates)


def consensus(df: DataFrame, key: str, order: str, text: str, metric: str = "weighted", pool: int | None = None) -> DataFrame:
    """(key, text, score, candidates) for each key's rows. All distinct candidates enter a choice, whose cost grows with their square; a `pool` takes the first in order alone."""
    c = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    g = df.where(F.col(text).isNotNull()).groupBy(key).agg(c.alias("c"))
    return g.select(key, chosen(F.col("c"), metric, pool).alias("x"), F.size("c").alias("candidates")).select(key, "x.*", "candidates")
