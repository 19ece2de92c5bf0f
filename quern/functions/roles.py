"""What each byte of a text stands for: letters, separators, brackets, damage or numbers, as ids of a byte vocabulary."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The roles in their order, the first byte's id, and the characters of each role.
ROLES = ("pad", "alpha", "punctuation", "boundary", "damage", "numeric")
PAD, ALPHA, PUNCTUATION, BOUNDARY, DAMAGE, NUMERIC = range(6)
FIRST_BYTE, AFTER_BYTES = 3, 259
SEPARATORS, BRACKETS, FRACTIONS = b"-=.: ", b"{}()[]", "½⅓⅔¼¾"


def role_table(size: int = 384) -> np.ndarray:
    """The role of each id by itself."""
    out = np.full(size, ALPHA)
    out[:FIRST_BYTE] = PAD
    out[AFTER_BYTES:] = PAD
    for chars, role in ((SEPARATORS, PUNCTUATION), (BRACKETS, BOUNDARY), (b"0123456789", NUMERIC)):
        out[np.frombuffer(chars, np.uint8) + FIRST_BYTE] = role
    return out


_TABLE = role_table()


def _spelled(text: str) -> str:
    """A text as a string of its ids, one character each."""
    return "".join(chr(b + FIRST_BYTE) for b in text.encode())


_GAPS = re.compile("|".join(re.escape(_spelled(x)) for x in ("<gap>", "...")))
_BRACKETED = re.compile(re.escape(_spelled("[")) + "[^" + re.escape(_spelled("]")) + "]*")
_X = _spelled("x")
_FRACTIONS = re.compile("|".join(re.escape(_spelled(x)) for x in FRACTIONS))


def roles(ids: np.ndarray, without: frozenset[int] = frozenset()) -> np.ndarray:
    """The role of each id in context; roles `without` are those of letters."""
    out = _TABLE[np.clip(ids, 0, len(_TABLE) - 1)].copy()
    spelled = "".join(map(chr, np.maximum(ids, 0).tolist()))
    if DAMAGE not in without:
        for m in _GAPS.finditer(spelled):
            out[m.start() : m.end()] = DAMAGE
        for m in _BRACKETED.finditer(spelled):
            out[[i for i in range(*m.span()) if spelled[i] == _X]] = DAMAGE
    if NUMERIC not in without:
        for m in _FRACTIONS.finditer(spelled):
            out[m.start() : m.end()] = NUMERIC
    out[np.isin(out, list(without))] = ALPHA
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_roles(ids: pd.Series) -> pd.Series:
    """The roles of arrays of ids."""
    return pd.Series([roles(np.asarray(x, np.int64)).tolist() if x is not None else None for x in ids])


def text_ids(text: Column) -> Column:
    """A text's bytes as ids, without an end."""
    b = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    at = F.when(F.octet_length(b) > 0, F.sequence(F.lit(1), F.octet_length(b))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int") + FIRST_BYTE)


def role_distribution(df: DataFrame, ids: str) -> DataFrame:
    """(role, n, share) over all ids of a table; each row counts its own first."""

    @F.pandas_udf("array<long>")
    def count(arrays: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(roles(np.asarray(x if x is not None else [], np.int64)), minlength=len(ROLES)).tolist() for x in arrays])

    sums = df.select(count(ids).alias("c")).agg(*[F.sum(F.col("c")[i]).alias(r) for i, r in enumerate(ROLES)])
    whole = sum((F.coalesce(F.col(r), F.lit(0)) for r in ROLES), F.lit(0))
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(r), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.col(r), whole), F.lit(0.0)).alias("share")) for r in ROLES])
    return sums.select(F.explode(rows).alias("x")).select("x.*")
