"""Rewards of answers: a likeness, less penalties, plus what is right in numbers and names. Expressions over one scoring call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import metrics
from quern.functions.features import entities
from quern.functions.text import word_count


@F.pandas_udf(T.StructType([T.StructField("chrf", T.DoubleType()), T.StructField("bleu", T.DoubleType())]))
def likeness(answer: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Sentence chrF and BLEU of each pair, over whole batches."""
    rows = [(metrics.sentence_chrf(a or "", r or ""), metrics.sentence_bleu(a or "", r or "")) for a, r in zip(answer, reference, strict=True)]
    return pd.DataFrame(rows, columns=["chrf", "bleu"])


def base_reward(scores: Column, kind: str = "mixed", chrf: float = 0.6, bleu: float = 0.4) -> Column:
    """One measure, their mean by weights, or their geometric mean, neither below 0.01."""
    c, b = scores["chrf"], scores["bleu"]
    kinds = {
        "chrf": c,
        "bleu": b,
        "geom_mean": F.sqrt(F.greatest(c, F.lit(0.01)) * F.greatest(b, F.lit(0.01))),
        "mixed": chrf * c + bleu * b,
    }
    return kinds.get(kind, c)


def bonus(answer: Column, reference: Column, numbers: float = 5.0, names: float = 5.0, whole: int = 10) -> Column:
    """The shares of the reference's numbers and names that are there, less for references of few words."""
    found = numbers * metrics.match_share(metrics.number_tokens(reference), metrics.number_tokens(answer)) + names * metrics.match_share(entities(reference), entities(answer))
    size = F.greatest(word_count(reference), F.lit(1)) / whole
    return found * F.greatest(F.lit(0.5), F.least(F.lit(1.0), size))


def reward(answer: Column, reference: Column, kind: str = "mixed", baseline: float = 0.0, scores: Column | None = None, **options) -> Column:
    """The composite reward; 0 for an empty answer."""
    a, r = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(reference, F.lit("")))
    base = base_reward(likeness(a, r) if scores is None else scores, kind)
    loss = metrics.repetition_penalty(a) + metrics.length_penalty(a, r) + metrics.coverage_penalty(a, r)
    return F.when(a == "", 0.0).otherwise(base - loss + bonus(a, r, **options) - baseline)


def mixed_reward(answer: Column, reference: Column, chrf: float = 0.6, bleu: float = 0.4, scores: Column | None = None) -> Column:
    """The mixed likeness less the length penalty; 0 where either text is empty."""
    a, r = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(reference, F.lit("")))
    base = base_reward(likeness(a, r) if scores is None else scores, "mixed", chrf, bleu)
    return F.when((a == "") | (r == ""), 0.0).otherwise(base - metrics.length_penalty(a, r))
