"""Feature columns of text pairs, document types and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators.filters import contains_any

#: Word and entity patterns, words that count as numbers, and the marks of document types.
TARGET_WORD = r"([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?)"
NUMBER = r"^\d+(?:/\d+)?(?:\.\d+)?$"
ENTITY = r"(?U)\b([A-ZŠṢṬḪ][A-Za-zāēīūšṣṭḫĀĒĪŪŠṢṬḪ]+(?:-[A-Za-zāēīūšṣṭḫĀĒĪŪŠṢṬḪ]+)*)\b"
ENTITY_STOP = "The From To And Or If Then Month Year Witness Witnessed Seal Silver Copper Gold Before Concerning Total".split()
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten mina minas shekel shekels talent talents kor gur "
    "liters litres measure measures ban jar jars silver copper gold interest principal"
).split()
PAYMENT = ("owe", "owes", "owed", "pay", "pays", "paid", "repay", "payment", "deliver", "delivered")
WITNESS = ("witnessed by", "witnesses", "seal of", "sealed by")
LOAN = ("interest", "owes", "silver", "will pay", "debt", "principal")
LETTER = (" to ", " from ", "speak to", "say to", "message")
ACCOUNT = ("total", "balance", "list of", "account", "accounts", "received", "expenditure")
SOURCE_ACCOUNT = ("ma-na", "gín", "kù.babbar", "ku.babbar", "an.na", "túg", "silver", "tin")
LEGAL = ("contract", "lawsuit", "judge", "verdict", "claim", "dispute", "sworn", "testimony")
OATH = ("swore", "oath", "swear", "swearing")
SOURCE_OATH = ("gír ša", "it-ma-ma", "it-mu-ú", "ma-mi-tam", "ta-mu-ú")
DATE = ("eponym", "eponymy")
SOURCE_DATE = ("itu.kam", "li-mu-um", "li-mu-um-ma")


def target_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TARGET_WORD), 1)


def numbers(text: Column) -> Column:
    return F.filter(F.transform(target_words(text), lambda x: F.lower(x)), lambda x: x.rlike(NUMBER) | x.isin(NUMBER_WORDS))


def entities(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), 1), lambda x: ~x.isin(ENTITY_STOP))


def _times(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def document_type(source: Column, target: Column) -> Column:
    """One of nine types; the first rule that holds decides."""
    s, t = F.trim(source), F.trim(target)
    sl, tl = F.lower(s), F.lower(t)
    speaks = sl.contains("qí-bi-ma") | sl.contains("qi-bi-ma")
    says = sl.contains("um-ma")
    broken = (_times(sl, "<gap>") + _times(tl, "<gap>") >= 2) | (_times(s, "...") + _times(t, "...") >= 2) | (_times(s, "…") + _times(t, "…") >= 2)
    letter = (sl.startswith("a-na ") & (speaks | says)) | (says & (speaks | sl.contains("qí-bi4-ma"))) | t.startswith("To ") | t.startswith("From ") | (contains_any(tl, LETTER) & tl.contains("to ") & tl.contains(" from "))
    return (
        F.when(broken, "fragmentary")
        .when(contains_any(tl, WITNESS), "witness")
        .when(contains_any(tl, LOAN), "loan")
        .when(letter, "letter")
        .when(contains_any(tl, ACCOUNT) | contains_any(sl, SOURCE_ACCOUNT), "account")
        .when(contains_any(tl, LEGAL), "legal")
        .when(contains_any(tl, OATH) | contains_any(sl, SOURCE_OATH), "oath")
        .when(contains_any(tl, DATE) | contains_any(sl, SOURCE_DATE), "date")
        .otherwise("other")
    )


def pair_features(df: DataFrame, source: str, target: str) -> DataFrame:
    """Lengths, ratios, flags and the document type of each pair, in one projection."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    d = df.withColumns({"__s": words(s), "__t": target_words(t), "__n": numbers(t), "__e": entities(t)})
    n_src, n_tgt = F.size("__s"), F.size("__t")
    one = F.lit(1)
    low = F.lower(t)
    d = d.withColumns({
        "src_len_char": F.length(s), "src_len_tok": n_src, "tgt_len_tok": n_tgt,
        "len_ratio": n_tgt / F.greatest(n_src, one),
        "gap_count": F.size(F.filter("__s", lambda x: F.lower(x) == "<gap>")),
        "num_count": F.size("__n"), "entity_count": F.size("__e"),
        "doc_type": document_type(s, t),
        "avg_word_len": F.when(n_tgt == 0, 0.0).otherwise(F.aggregate("__t", F.lit(0), lambda a, x: a + F.length(x)) / n_tgt),
        "has_interest": low.contains("interest"), "has_witness": contains_any(low, WITNESS), "has_payment": contains_any(low, PAYMENT),
    })
    d = d.withColumns({"gap_ratio": F.col("gap_count") / F.greatest(n_src, one), "num_ratio": F.col("num_count") / F.greatest(n_tgt, one), "entity_ratio": F.col("entity_count") / F.greatest(n_tgt, one)})
    return d.drop("__s", "__t", "__n", "__e")


def source_label(source: Column, noisy: tuple[str, ...] = ("ocr", "silver", "synth", "synthetic", "noisy", "backtranslation", "dictionary")) -> Column:
    """`ocr` for every noisy origin, else `official`."""
    return F.when(F.lower(F.trim(source)).isin(list(noisy)), "ocr").otherwise("official")


def damaged(text: Column) -> Column:
    return text.contains("<gap>") | text.contains("[") | text.contains("]") | text.rlike(r"(?iU)\bx\b") | text.contains("⸢") | text.contains("⸣") | text.contains("...")


def meta_prefix(text: Column, data_source: Column, variety: Column) -> Column:
    """Variety, origin and state in four letters and a space, as OAOI."""
    v = F.trim(variety)
    code = F.when(v == "OB", "OB").when(v.isin("OAkk", "Sumerian"), "XX").otherwise("OA")
    return F.concat(code, F.when(source_label(data_source) == "official", "O").otherwise("N"), F.when(damaged(text), "D").otherwise("I"), F.lit(" "))


def strip_prefix(text: Column) -> Column:
    return F.regexp_replace(text, "^(?:OA|OB|XX)[ON][ID] ", "")


def hints(text: Column, lexicon: Column, most: int = 6) -> Column:
    """The first `most` distinct words of a text that a map of word to gloss knows, as word=gloss."""
    known = F.filter(F.array_distinct(words(text)), lambda w: F.element_at(lexicon, w).isNotNull())
    return F.transform(F.slice(known, 1, most), lambda w: F.concat(w, F.lit("="), F.element_at(lexicon, w)))
