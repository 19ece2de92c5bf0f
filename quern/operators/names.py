"""Proper names: lexicons of them, what a text says of them, and the examples chosen to show them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import let, squeeze, word_count, words

# Types of names, words that are none, marks of names, and the patterns of the corpus's names.
NAME_TYPES = ("PN", "GN", "DN")
COMMON_WORDS = ("The", "This", "That", "And", "But", "For", "Not", "With", "From", "Into")
NAME_MARKS = ("{d}", "DUMU", "KIŠIB")
PLACE_MARK = "{ki}"
FORM_EDGES = ".,;:?!()[]\"'>"
_LOW = "a-zāēīūšṣṭḫ"
GODS = r"(?:Šamaš|Ištar|Aššur|Adad|Ilabrat|Suen|Sin|Nergal|Enlil|Marduk|Nabû|Aya|Dagan|Ilī|Bēl|Kubum|Laban|Amurrum|Išḫara|Ana)"
NAME_PATTERNS = (
    rf"\b([A-ZŠṢṬḪ][{_LOW}]*(?:-[A-Za-zāēīūšṣṭḫ]+)+)",
    rf"\bs\. ([A-ZŠṢṬḪ][{_LOW}-]+)",
    rf"\b([A-ZŠṢṬḪ][{_LOW}]*[āēīūšṣṭḫ][{_LOW}]*)\b",
    rf"\b({GODS}[-]?[a-zāēīūšṣṭḫA-ZŠṢṬḪ-]*)\b",
    rf"\b([A-ZŠṢṬḪ][{_LOW}]*-{GODS})\b",
    rf"\b(Šū-[A-ZŠṢṬḪ][{_LOW}-]*)\b",
)
#: Words that the third pattern finds and that are no names.
NO_NAMES = ("The", "From", "To", "If", "He", "She", "They", "Month", "Year", "Witness", "Witnesses", "Seal")
TARGET_NAME = r"\b([A-Z][a-zāēīūšṣṭḫ]+(?:-[A-Za-zāēīūšṣṭḫ]+)*)\b"
#: What an example is worth for showing a name.
FOCUS = (("To ", "starts", 4), ("Seal of ", "starts", 4), (" son of ", "has", 3), (" owes ", "has", 2))


def name_set(lexicon: DataFrame, norm: str) -> DataFrame:
    """The distinct names of a lexicon: capitalised, longer than two letters, no common words."""
    n = F.trim(norm)
    return lexicon.select(n.alias("name")).where(F.col("name").rlike(r"(?U)^\p{Lu}") & (F.length("name") > 2) & ~F.col("name").isin(*COMMON_WORDS)).distinct()


def name_lexicon(lexicon: DataFrame, form: str, norm: str, kind: str, order: Column, clean_form=None, clean_norm=None, kinds: tuple[str, ...] = NAME_TYPES) -> DataFrame:
    """(form, norm) of the names of a lexicon, both cleaned; the first of a form counts. Longest forms go first where an order is asked for."""
    clean_form = clean_form or (lambda c: F.lower(squeeze(c)))
    clean_norm = clean_norm or squeeze
    d = lexicon.where(F.col(kind).isin(*kinds)).select(clean_form(F.col(form)).alias("form"), F.btrim(clean_norm(F.col(norm)), F.lit(".,;:?! ")).alias("norm"), order.alias("ord"))
    d = d.where("form <> '' AND norm <> ''")
    return d.groupBy("form").agg(F.min_by("norm", F.struct("ord", "norm")).alias("norm"))


def longest_first(names: DataFrame, form: str = "form") -> DataFrame:
    """The order in which forms are to be looked for."""
    return names.orderBy(F.length(form).desc(), form)


def names_of(text: Column) -> Column:
    """The distinct names of a text by the corpus's patterns, in alphabetical order."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){p}"), 1) for p in NAME_PATTERNS]
    found[2] = F.filter(found[2], lambda x: ~x.isin(*NO_NAMES))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def name_whitelist(df: DataFrame, text: str) -> DataFrame:
    """The distinct names of a table's texts."""
    return df.select(F.explode(names_of(F.col(text))).alias("name")).distinct()


def marked_forms(text: Column, places: bool = False) -> Column:
    """The distinct forms that a mark before them, or in them for places, tells to be names, in their order."""

    def bare(w: Column) -> Column:
        return F.lower(F.btrim(w, F.lit(FORM_EDGES)))

    def found(w: Column) -> Column:
        at = F.transform(w, lambda x, i: F.when((F.get(w, i - 1).isin(*NAME_MARKS)) & (i > 0), bare(x)).when(F.lit(places) & x.contains(PLACE_MARK), bare(F.replace(x, F.lit(PLACE_MARK), F.lit("")))))
        return F.array_distinct(F.array_compact(at))

    return let(words(text), found)


def _spelt_alike(forms: list[str], found: list[str], least: float, most: int) -> list[str]:
    bare = [(n, n.lower().replace("-", "")) for n in found]
    hints = []
    for f in forms if bare else []:
        ratio, _, name = max((difflib.SequenceMatcher(None, f.replace("-", ""), b).ratio(), -k, n) for k, (n, b) in enumerate(bare))
        if ratio >= least:
            hints.append(f"{f}={name}")
    return hints[:most]


def own_hints(df: DataFrame, source: str, target: str, name: str = "hints", most: int = 10, least_length: int = 4, stop: tuple[str, ...] = (), least: float = 0.6) -> DataFrame:
    """Adds form=name of the marked forms of a source that are spelt like a name of its target, the first `most`.

    The likeness is that of matching blocks over syllables without hyphens;
    of equals the first name counts.
    """

    forms = F.filter(marked_forms(F.col(source), places=True), lambda f: (F.length(f) >= least_length) & ~f.isin(*stop or ("",)))
    found = F.regexp_extract_all(F.coalesce(target, F.lit("")), F.lit(f"(?U){TARGET_NAME}"), 1)
    d, own = df.withColumns({"hint_forms": forms, "hint_names": found}), list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column("hint_forms").to_pylist(), batch.column("hint_names").to_pylist(), strict=True)
            hints = [_spelt_alike(fs or [], ns or [], least, most) for fs, ns in given]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(hints, pa.list_(pa.string()))], [*own, name])

    return d.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))


def lexicon_hints(source: Column, lexicon: Column, most: int = 10, least_length: int = 4, places: bool = False) -> Column:
    """form=name of the marked forms that a map knows, the first `most`."""
    known = F.filter(marked_forms(source, places), lambda f: (F.length(f) >= least_length) & F.element_at(lexicon, f).isNotNull())
    return F.transform(F.slice(known, 1, most), lambda f: F.concat(f, F.lit("="), F.element_at(lexicon, f)))


def with_hints(source: Column, found: Column) -> Column:
    """The source with its hints after it; as it is where there are none or it has some."""
    return F.when((F.size(found) == 0) | source.contains("## HINTS:"), source).otherwise(F.concat(source, F.lit(" ## HINTS: "), F.array_join(found, "; ")))


def containing(names: DataFrame, name: str, df: DataFrame, key: str, text: str) -> DataFrame:
    """(name, key) of every row whose text has a name as whole words.

    A text's runs of as many words as a name has are its candidates: an
    equality join, no name meets every text. What stands between the words is
    compared for the candidates alone.
    """
    word = F.lit(r"(?U)(\w+)")
    n = names.select(F.col(name).alias("name"), F.array_join(F.regexp_extract_all(F.col(name), word, 1), " ").alias("spelt")).where("spelt <> ''").distinct()
    sizes = [r[0] for r in n.select(F.size(F.split("spelt", " ")).alias("s")).distinct().orderBy("s").collect()]  # a few whole numbers
    if not sizes:
        return n.select("name").crossJoin(df.select(key).limit(0))
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), word, 1)

    def of(w: Column, size: int) -> Column:
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    runs = let(parts, lambda w: F.array_distinct(F.flatten(F.array(*[of(w, s) for s in sizes]))))
    d = df.select(key, F.col(text).alias("whole"), F.explode(runs).alias("run")).join(n, F.col("run") == F.col("spelt"))
    return d.where(F.rlike("whole", F.concat(F.lit(r"(?U)\b\Q"), "name", F.lit(r"\E\b")))).select("name", key).distinct()


def focus_score(source: Column, target: Column) -> Column:
    """What a short pair with a telling frame is worth."""
    worth = F.lit(0)
    for mark, how, points in FOCUS:
        worth = worth + F.when(target.startswith(mark) if how == "starts" else target.contains(mark), points).otherwise(0)
    return worth - word_count(source) - word_count(target)


def name_focus(pairs: DataFrame, key: str, source: str, target: str, ranked: DataFrame, name: str, misses: str, per_name: int = 2, most: int = 60) -> DataFrame:
    """Examples for names that were missed, the most missed first: (number, key, source, target, name, misses).

    A name takes its best pairs, none that a name before it took. A name can
    lose at most `per_name` pairs to each name before it, so its best
    `per_name * place` pairs are enough to choose from; the choice itself goes
    over the first `most` names only, whose number is a parameter.
    """
    order = Window.orderBy(F.col(misses).desc(), name)
    first = ranked.orderBy(F.col(misses).desc(), name).limit(most).withColumn("place", F.row_number().over(order))  # at most `most` rows
    found = containing(first.select(name), name, pairs, key, target)
    d = found.join(F.broadcast(first.select(F.col(name).alias("n"), misses, "place")), F.col("name") == F.col("n")).join(pairs.select(F.col(key).alias("k"), source, target), F.col(key) == F.col("k"))
    d = d.select("place", "name", misses, key, source, target, focus_score(F.col(source), F.col(target)).alias("worth"), word_count(F.col(source)).alias("s"), word_count(F.col(target)).alias("t"))
    best = Window.partitionBy("place").orderBy(F.desc("worth"), "s", "t", key)
    d = d.withColumn("i", F.row_number().over(best)).where(F.col("i") <= F.col("place") * per_name)
    schema = f"number int, {key} {pairs.schema[key].dataType.simpleString()}, {source} string, {target} string, name string, {misses} long"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        rows = []
        for _, own in pdf.sort_values(["place", "i"]).groupby("place", sort=True):
            free = own[~own[key].isin(taken)].head(per_name)
            taken.update(free[key])
            rows.extend(free.itertuples(index=False))
        rows = rows[:most]
        return pd.DataFrame([(n + 1, getattr(r, key), getattr(r, source), getattr(r, target), r.name, getattr(r, misses)) for n, r in enumerate(rows)], columns=["number", key, source, target, "name", misses])

    # one group of at most `most` names and per_name * most pairs of each
    return d.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(choose, schema)
