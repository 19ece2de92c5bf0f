"""Whole builds of corpus families: the screens, joins and cleaners in the order in which a family goes through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import editions, features, records
from quern.functions.text import squeeze
from quern.operators import filters, joins, names, screening

Clean = Callable[[Column], Column]
_S, _T = "source_text", "target_text"


def changed_sources(df: DataFrame, key: str, text: str, strip: Clean = records.without_left_prefix, clean: Clean = editions.corpus_source) -> DataFrame:
    """(key, text): the sources that lose a line's prefix, cleaned anew; others are left out."""
    bare = strip(F.col(text))
    return df.where((F.coalesce(text, F.lit("")) != "") & (bare != F.col(text))).select(key, clean(bare).alias(text))


def with_columns_of(df: DataFrame, **constants) -> DataFrame:
    """The rows with constant columns, as of their origin."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def pair_keys(df: DataFrame, clean_source: Clean = editions.corpus_source, clean_target: Clean = editions.corpus_target) -> DataFrame:
    """Adds `pair_key`: both sides cleaned, for joins of versions that were cleaned otherwise."""
    return df.withColumn("pair_key", F.concat_ws("\u0001", clean_source(F.col(_S)), clean_target(F.col(_T))))


def merged(old: DataFrame, new: DataFrame, key: str, **constants) -> DataFrame:
    """The old rows and the new ones with keys of their own; columns of either side, and the constants of the new."""
    return joins.append_new(old, with_columns_of(new, **constants), [key])


def catalogue_family(df: DataFrame, variety: str, source: str = _S, target: str = _T, clean_source: Clean = records.record_source, clean_target: Clean = records.record_target) -> DataFrame:
    """Rows with both sides, cleaned, that say something; with the variety and their origin."""
    d = df.where(F.col(source).isNotNull() & F.col(target).isNotNull() & ~records.boilerplate(F.col(target)))
    d = d.withColumns({source: clean_source(F.col(source)), target: clean_target(F.col(target))})
    d = d.where((F.col(source) != "") & (F.col(target) != "") & ~records.boilerplate(F.col(target)))
    return with_columns_of(d, variety=variety, data_source="official")


def flagged_subset(df: DataFrame, key: str, order: str, flag: Column, variety: str) -> DataFrame:
    """Rows that a flag says are translated, cleaned, of some quality, the first of each id."""
    d = df.where(F.coalesce(flag, F.lit(False))).withColumns({_S: editions.corpus_source(F.col(_S)), _T: editions.corpus_target(F.col(_T))})
    d = d.where((F.trim(key) != "") & (F.col(_S) != "") & (F.col(_T) != "") & (F.size(F.split(_T, " ")) >= 3))
    return with_columns_of(joins.first_by(d, [key], [F.col(order)]), variety=variety)


def sentence_family(df: DataFrame, key: str = "row_id", order: str = "ord", clean_source: Clean = editions.corpus_source, clean_target: Clean = editions.corpus_target, document_columns: tuple[str, ...] = (_S, _T)) -> DataFrame:
    """A family of sentences and grouped documents as one row a text: (key, source_text, target_text, variety).

    Needs `align_type` and `line_ref`. Whole documents of other domains go
    first; then each pass of screens works on texts that are cleaned anew, as
    what one pass takes out lets the next see more. Of the rows that are left
    of a text the first in order stays.
    """
    base = records.base_id(F.col(key))
    d = df.withColumns({"base_id": base, "had_placeholder": screening.has_placeholder(F.col(_S), F.col(_T))})
    fixed = changed_sources(d, key, _S, clean=clean_source).withColumn("o", F.lit(0))
    d = joins.override(d, fixed, key, [_S], F.col("o")).drop("changed")
    found = screening.document_reasons(d, "base_id", [order], list(document_columns))
    d = screening.with_document_reasons(d, "base_id", found).where("drop_reason IS NULL").drop("drop_reason")
    s, t, kind = F.col(_S), F.col(_T), F.col("align_type")

    def cleaned(x: DataFrame) -> DataFrame:
        return x.withColumns({_S: clean_source(s), _T: clean_target(t)})

    d = cleaned(d).where(~screening.fragmentary(s, t) & ~screening.sentence_metadata(t, kind) & ~F.col("had_placeholder"))
    d = cleaned(d).where(~(screening.is_sentence(kind) & filters.alignment_risk(s, t)) & ~screening.single_line_sentence(s, t, kind, F.col("line_ref")))
    heavy = F.lit(False)
    for sign in screening.fragment_signs(s, t, kind).values():
        heavy = heavy | sign
    d = cleaned(d).where(~screening.residual_editorial(t) & ~heavy & filters.pair_reason(s, t).isNull())
    d = screening.repaired_or_dropped(d, key, _T).drop("french_state")
    d = d.select(F.col("base_id").alias(key), squeeze(s).alias(_S), squeeze(t).alias(_T), F.lit("OB").alias("variety"), order).where(f"{key} <> '' AND {_S} <> '' AND {_T} <> ''")
    return joins.first_by(d, [key], [F.col(order)]).drop(order)


def page_candidates(df: DataFrame, page: list[str], source: str = _S, target: str = _T, least: int = 1) -> DataFrame:
    """Candidate pairs of pages read by recognition: texts repaired, a reason for each that is rejected, and how many a page keeps.

    Adds `reason` (null keeps) and `page_ok`: pages with fewer than `least` pairs left have none.
    """
    d = df.withColumns({source: records.plain_space(records.without_side_marks(records.joined_brackets(editions.read_source(F.col(source))))), target: records.plain_space(editions.read_target(F.col(target)))})
    d = d.withColumn("reason", screening.candidate_reason(F.col(source), F.col(target)))
    left = d.groupBy(*page).agg(F.count_if(F.col("reason").isNull()).alias("left_pairs")).withColumnsRenamed({p: f"own_{p}" for p in page})
    on = [F.col(p).eqNullSafe(F.col(f"own_{p}")) for p in page]
    return d.join(left, on).withColumn("page_ok", F.col("left_pairs") >= least).drop("left_pairs", *[f"own_{p}" for p in page])


def inference_inputs(df: DataFrame, text: str, variety: str, lexicon: Column | None = None, months: bool = False) -> DataFrame:
    """Adds `input_text`: the cleaned source, hints and months where asked for, and the prefix that tells variety and state."""
    from quern.operators.builders import month_hints

    t = editions.broken_braces(editions.corpus_source(F.col(text)))
    d = df.withColumn("input_text", t)
    if lexicon is not None:
        d = d.withColumn("input_text", names.with_hints(F.col("input_text"), names.lexicon_hints(F.col("input_text"), lexicon)))
    if months:
        d = d.withColumn("input_text", month_hints(F.col("input_text")))
    return d.withColumn("input_text", F.concat(features.meta_prefix(F.col(text), F.lit("official"), F.col(variety)), F.col("input_text")))


def task_prefix(variety: Column, prefixes: dict[str, str], default: str) -> Column:
    """The spelled-out prefix of a variety, or the default."""
    out = F.lit(default)
    for name, prefix in prefixes.items():
        out = F.when(F.trim(variety) == name, prefix).otherwise(out)
    return out


def gathered(parts: list[DataFrame], order: str) -> DataFrame:
    """The answers of several workers in one table and in the order of the rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(order)
