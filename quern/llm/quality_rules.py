"""Quality rules: a threshold table compiled into one Spark projection.

DataFrame functions only. Every measure is computed inside the row, so the
plan has no exchange: a hot source, a group of copies or a very long text
costs its own length and nothing else. A repeated word window is found by
sorting the row's own (hash, position) pairs, which is n log n in its words;
neighbours of equal hash are compared by their words, so windows of other
words never count as equal (two of one 64-bit hash that stand between equal
ones in a text could part them).

Defined results: a null or empty text has no words, all counts 0 and fails
the base rule. Ties and repeated rows are judged row by row, alike. An empty
table gives an empty table. Extra columns stay; one named like an output
gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r "

#: Frequent function words of the languages in use; a text without any is no running prose.
STOP_WORDS = tuple(
    "the of and to a in is that it for was on with as be by are this at from "
    "der die und den von zu das sich mit des auf für ist im nicht dem ein eine als "
    "de la le et les en un du une que est pour par dans avec qui pas sur au "
    "el y los las se del por con no su para es al lo".split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure`, an SQL expression over the base counts, is outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, per line or per character.
RULES = (
    Rule("mean_word_length", "try_divide(word_chars, n_words)", 2.0, 15.0),
    Rule("symbols_per_word", "try_divide(n_symbols, n_words)", None, 0.2),
    Rule("duplicate_lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", 0.03, None),
    Rule("upper_case", "try_divide(n_upper, word_chars)", None, 0.5),
    Rule("ellipsis_lines", "try_divide(n_ellipsis_lines, n_lines)", None, 0.5),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _same(other: str) -> str:
    """SQL for: the window at place `other` has the words of the one at x.i."""
    return " and ".join(f"w[x.i + {k}] = w[{other} + {k}]" for k in range(3))


def measures(df: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """`df` with the base counts and the counts that the rules use.

    Chained projections keep every array computed once: Catalyst does not
    merge a projection into another that refers to it more than once.
    """
    keep = [c for c in df.columns if c.lower() not in {*BASE, "n_lines", "n_stop_words", "n_upper", "n_ellipsis_lines"}]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    d = df.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    space = SPACE.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\x0b", "\\u000B").replace("\x0c", "\\u000C")
    d = d.select("row", "t", F.expr(f"trim(BOTH '{space}' FROM t)").alias("s"))
    d = d.select(
        "row", "t",
        F.expr(r"if(s = '', cast(array() as array<string>), split(s, '[\\x20\\x09-\\x0D]+'))").alias("w"),
        F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    d = d.select(
        "row", "w", "lines",
        F.expr("array_join(w, '')").alias("joined"),
        F.expr(r"regexp_count(t, '[#*$%&|<>]')").alias("n_symbols"),
        # with the window's hash first, sorting brings the places of a window together
        F.expr("if(size(w) < 3, cast(array() as array<struct<h:bigint,i:int>>), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))").alias("g"),
    )
    d = d.select("row", "w", "lines", "joined", "n_symbols", F.expr("sort_array(g)").alias("g"))
    d = d.select(
        "row", "w", "lines", "joined", "n_symbols",
        # places whose window equals the one before or after it in the sorted order
        F.expr(f"transform(filter(g, (x, j) -> (j > 0 and x.h = get(g, j - 1).h and {_same('get(g, j - 1).i')}) or (x.h = get(g, j + 1).h and {_same('get(g, j + 1).i')})), x -> x.i)").alias("p"),
    )
    d = d.select(
        "row",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(joined) as bigint)").alias("word_chars"),
        F.expr("cast(n_symbols as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(if(size(p) = 0, 0, size(array_distinct(concat(p, transform(p, x -> x + 1), transform(p, x -> x + 2))))) as bigint)").alias("n_repeat_words"),
        F.expr("size(lines)").alias("n_lines"),
        F.expr(f"size(filter(w, x -> lower(x) in ({_sql_list(stop_words)})))").alias("n_stop_words"),
        F.expr(r"length(joined) - length(regexp_replace(joined, '\\p{Lu}+', ''))").alias("n_upper"),
        F.expr(r"size(filter(lines, x -> x rlike '(\\.\\.\\.|\\u2026)[\\x20\\x09-\\x0D]*$'))").alias("n_ellipsis_lines"),
    )
    return d.select("row.*", *d.columns[1:])


def fails(rule: Rule) -> Column:
    """True where the rule's measure is outside its bounds; a measure over nothing passes."""
    x = F.expr(rule.measure)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (x < rule.low)
    if rule.high is not None:
        bad = bad | (x > rule.high)
    return F.coalesce(bad, F.lit(False))


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """`df` with counts, `base_failed`, `failed_rules` (names, in the table's order) and `kept`."""
    own = {*BASE, "n_lines", "n_stop_words", "n_upper", "n_ellipsis_lines", "base_failed", "failed_rules", "kept"}
    d = measures(df.drop(*[c for c in df.columns if c.lower() in own and c != text_col]), text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))
    d = d.withColumns({"base_failed": base, "failed_rules": names})
    # a filter on a non-deterministic column stays above the projections: pushed below, it would repeat their arrays many times over
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.spark_partition_id() >= 0))
