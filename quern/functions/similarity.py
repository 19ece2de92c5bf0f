"""String similarity that has no built-in function."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str, b: str) -> float:
    """The gestalt ratio of two strings; asymmetric, with the popular-element rule from 200 characters on."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def edits(a: list[str], b: list[str]) -> dict[str, int]:
    """Words inserted, deleted and replaced on the way from a to b."""
    out = {"insert": 0, "delete": 0, "replace": 0}
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            out[tag] += max(i2 - i1, j2 - j1)
    return out


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("insert", "delete", "replace")]))
def word_edits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edits((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], columns=["insert", "delete", "replace"])


@F.pandas_udf(T.DoubleType())
def opcode_error_rate(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """The lengths of the spans that differ, over the reference's length: no edit distance, but close to it."""

    def one(h: str, r: str) -> float:
        spans = (max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, r, h).get_opcodes() if tag != "equal")
        return sum(spans) / max(len(r), 1)

    return pd.Series([one(h or "", r or "") for h, r in zip(hypothesis, reference, strict=True)])


@F.pandas_udf(T.BooleanType())
def fuzzy_word(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two words are one but for a few letters: lengths within a factor of two, and a gestalt ratio of 0.8."""
    return pd.Series([bool(x and y) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.5 and ratio(x.lower(), y.lower()) >= 0.8 for x, y in zip(a, b, strict=True)])
