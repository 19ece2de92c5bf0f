"""Table contracts: the pair table, and checks of columns before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hub of the engine: one text pair a row. `ord` carries the order that first-wins and previous-row rules refer to.
PAIRS = T.StructType([T.StructField(n, T.StringType()) for n in ("row_id", "source_text", "target_text", "data_source", "variety")])


def require(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """`df`, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, column: str, default) -> Column:
    """The column where the table has it, else the default."""
    return F.col(f"`{column}`") if column in df.columns else F.lit(default)


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, with underscores before it until no table has such a column, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def no_nulls(df: DataFrame) -> DataFrame:
    """Null strings become empty at the way in, so that no literal 'nan' or 'null' arises later."""
    return df.na.fill("", subset=[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of a user's turn and the assistant's turn right after it: row_id, conv_id, turn, source_text, target_text.

    One exchange by conversation: the next turn is looked up by a window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"), F.lead("text").over(w).alias("next_text"))
    d = d.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    return d.select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), "conv_id", "turn", F.col("text").alias("source_text"), F.col("next_text").alias("target_text"))
