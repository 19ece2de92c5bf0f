"""Normalisers of record formats: transliteration files, scraped JSON, catalogue labels, answers of models."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import GAP, ascii_letters, fold, let, squeeze

_SYLLABLE = "a-záàéèíìúùšṣṭḫ"
#: Signs written in capitals when they stand alone.
CAPITALS = {"dumu": "DUMU", "lugal": "LUGAL", "igi": "IGI", "kišib": "KIŠIB", "kišib3": "KIŠIB", "ensí": "ENSÍ", "ensi2": "ENSÍ", "iti": "ITI", "mu": "MU"}
#: Period names and language codes, the first that occurs decides.
PERIODS = (
    ("old assyrian", "OA"), ("old babylonian", "OB"), ("old akkadian", "OAkk"), ("neo-babylonian", "NB"), ("achaemenid", "NB"), ("neo-assyrian", "NA"),
    ("middle babylonian", "MB"), ("middle assyrian", "MA"), ("ur iii", "UrIII"), ("ed i", "ED"),
)
LANGUAGES = (("akk", "Akkadian"), ("sux", "Sumerian"), ("qpc", "Proto-Cuneiform"), ("elx", "Elamite"), ("hit", "Hittite"), ("urartian", "Urartian"), ("xur", "Hurrian"), ("egy", "Egyptian"))


def _first(text: Column, table, default) -> Column:
    out = None
    for mark, value in table:
        out = F.when(text.contains(mark), value) if out is None else out.when(text.contains(mark), value)
    return out.otherwise(default)


def variety(period: Column) -> Column:
    return _first(F.lower(F.coalesce(period, F.lit(""))), PERIODS, F.lit("other"))


def language(code: Column) -> Column:
    c = F.lower(F.coalesce(code, F.lit("")))
    return F.when(c.contains("akk") & c.contains("sux"), "Akkadian-Sumerian").otherwise(_first(c, LANGUAGES, c))


def boilerplate(text: Column) -> Column:
    """Whole texts that say nothing."""
    return F.lower(F.trim(text)).isin("basket-of-tablets: <gap>", "...", GAP, "basket-of-tablets:", "basket of tablets")


def line_body(line: Column) -> Column:
    """A numbered line without its number, as 1. or 12'. or 1.a1."""
    return F.trim(F.regexp_replace(line, r"^[0-9]+[\p{L}0-9.']*[.']\s*", ""))


def capital_spans(text: Column) -> Column:
    """What stands between two underscores in capitals, without them: every second part."""
    return let(F.split(F.coalesce(text, F.lit("")), "_", -1), lambda p: F.when(F.size(p) % 2 == 0, F.array_join(p, "_")).otherwise(F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.upper(x)).otherwise(x)), "")))


def merged_tens(text: Column) -> Column:
    """A ten and a unit written apart as one number: 10 6 is 16; a count of tens as its number."""
    t = fold(text, [(rf"\b{n}\{{ú\}}", str(10 * n)) for n in range(1, 10)])
    return fold(t, [(rf"\b{n}0 (\d)\b", f"{n}$1") for n in range(1, 6)])


def record_source(text: Column) -> Column:
    """The source side of a record file in the engine's spelling."""
    t = merged_tens(fold(text, [(r"\b(\d+)diš\b", "$1"), (r"([½⅓⅔⅙⅚¼])\s*(?:diš|aš)\b", "$1")]))
    t = fold(t, [(r"\bgin2\b", "GÍN"), (r"(?i)\bšu-?nigin\b", "ŠU.NÍGIN")] + [(rf"(?<![{_SYLLABLE}-])\b{k}\b(?![{_SYLLABLE}-])", v) for k, v in CAPITALS.items()])
    return squeeze(fold(t, [(r"\{diš\}", ""), (r"(\S) +--+", "$1-"), (r"(\S) +-(\S)", "$1-$2"), (r"(\S)- +(\S)", "$1-$2")]))


def record_target(text: Column) -> Column:
    """The target side: dotted letters, literal notes and asides out, supplements without their parentheses."""
    t = fold(text, [(rf"{a},(?=[{_SYLLABLE}āēīū])", b) for a, b in (("S", "Ṣ"), ("T", "Ṭ"), ("s", "ṣ"), ("t", "ṭ"))])
    return squeeze(fold(t, [("_", " "), (r"\s*\blit\.\s*[^;.]*(?=[;.]|,\s*[A-Z]|$)", ""), (r"\([^)]*\?[^)]*\)", ""), (r"(?i)\((?:i\.e\.|seal impression|lines? \d|broken|colophon|erasure|uninscribed)[^)]*\)", ""), (r"\(([^)]{1,80})\)", "$1"), (r"\.\.+", ".")]))


def ascii_record(text: Column) -> Column:
    return capital_spans(ascii_letters(text))


def base_id(row_id: Column) -> Column:
    """An id without the eight hex digits before it."""
    return F.regexp_replace(row_id, "^[0-9a-f]{8}-", "")


def line_range(reference: Column) -> Column:
    """(first, last, text) of a line reference, for sorting; unreadable ones go last."""
    far = F.lit(10**6)
    lo = F.regexp_extract(reference, r"(\d+)", 1)
    hi = F.regexp_extract(reference, r"\d+\D+(\d+)", 1)
    return F.struct(F.when(lo != "", lo.cast("int")).otherwise(far).alias("first"), F.when(hi != "", hi.cast("int")).otherwise(F.when(lo != "", lo.cast("int")).otherwise(far)).alias("last"), reference.alias("text"))


def artifact_ids(html: Column) -> Column:
    """The distinct ids over 1000 that a result page links to, in order."""
    ids = F.transform(F.concat(F.regexp_extract_all(html, F.lit(r"/artifacts/(\d+)"), 1), F.regexp_extract_all(html, F.lit(r"\bP(\d{6})\b"), 1)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x > 1000)))


#: The shape of an artifact's JSON, as far as it is read.
ARTIFACT = "struct<id:string,genres:array<struct<genre:struct<genre:string>>>,languages:array<struct<language:struct<language:string>>>,period:struct<period:string>,inscription:struct<atf:string>>"


def artifact(json: Column) -> Column:
    """struct<id,genres,languages,period,atf> of an artifact's JSON; lists as texts with semicolons."""
    x = F.from_json(json, ARTIFACT)
    return F.struct(
        x["id"].alias("id"),
        F.array_join(F.transform(x["genres"], lambda g: g["genre"]["genre"]), "; ").alias("genres"),
        F.array_join(F.transform(x["languages"], lambda g: g["language"]["language"]), "; ").alias("languages"),
        x["period"]["period"].alias("period"), x["inscription"]["atf"].alias("atf"),
    )


def answer_of(content: str | None) -> str:
    """What a model's free text answers: its line `Translation:`, else its last line that is no list item."""
    lines = [x.strip() for x in (content or "").split("\n") if x.strip()]
    for x in lines:
        if x.startswith("Translation:") and x[12:].strip():
            return x[12:].strip()
    for x in reversed(lines):
        if len(x) > 5 and not x.startswith(("1.", "*")):
            return re.sub(r"^\d+\.\s*", "", x)[:200]
    return "\n".join(lines[-2:])


@F.pandas_udf(T.StringType())
def answer(content: pd.Series) -> pd.Series:
    return content.map(answer_of)


def numbered_lines(text: str | None, run: int = 3, jump: int = 4, mixed: bool = True) -> str:
    """Lines without their numbers where these are line numbers: nearly all go up by small steps, and some lines have none.

    `mixed` asks for a line without a number; without it a whole numbered text counts too.
    """
    lines = (text or "").split("\n")
    hits = [re.match(r"\s*(\d{1,3})['’]?(?=\s+(?:[\[(<{]|[^\W\d_]))", x) for x in lines]
    numbers = [int(h[1]) for h in hits if h]
    filled = sum(bool(x.strip()) for x in lines)
    steps = sum(0 < b - a <= jump for a, b in zip(numbers, numbers[1:], strict=False))
    bare = filled - len(numbers)
    if len(numbers) < max(run, filled // 3) or steps < max(2, len(numbers) - 2) or mixed and not bare:
        return text or ""
    return "\n".join(x[h.end() :].lstrip() if h else x for x, h in zip(lines, hits, strict=True))


@F.pandas_udf(T.StringType())
def without_line_numbers(text: pd.Series) -> pd.Series:
    return text.map(numbered_lines, na_action="ignore")


def tidy_braces(text: str | None, longest: int = 8) -> str:
    """Braces around one short token stay; nested, long, blank and unpaired ones go, with what they hold if paired."""
    t = text or ""
    while (n := re.sub(r"\{[^{}]*\{[^{}]*\}[^{}]*\}", " ", t)) != t:
        t = n
    parts = re.split(r"(\{[^{}]*\})", t)
    for i, p in enumerate(parts):
        if i % 2:
            inner = p[1:-1].strip().translate(str.maketrans("₂₄", "24"))
            parts[i] = f"{{{inner}}}" if re.fullmatch(rf"\w{{1,{longest}}}", inner) else " "
        else:
            parts[i] = re.sub(r"[{}]", " ", p)
    return " ".join("".join(parts).split())


@F.pandas_udf(T.StringType())
def sanitized_braces(text: pd.Series) -> pd.Series:
    return text.map(tidy_braces, na_action="ignore")


#: The fractions that a decimal may stand for.
FRACTIONS = {0.0: "", 1 / 6: "⅙", 0.25: "¼", 1 / 3: "⅓", 0.5: "½", 2 / 3: "⅔", 0.75: "¾", 5 / 6: "⅚"}


def snapped(text: str | None, tolerance: float = 2e-3) -> str:
    """Decimals within the tolerance of a fraction as that fraction, after a space behind a whole number; others stay."""
    def one(m: re.Match) -> str:
        whole, rest = divmod(float(m[0]), 1)
        near = min(FRACTIONS, key=lambda f: abs(f - rest))
        if abs(near - rest) > tolerance:
            return m[0]
        return " ".join(filter(None, (str(int(whole)) if whole or not FRACTIONS[near] else "", FRACTIONS[near])))

    return re.sub(r"(?<![\d.])\d+\.\d+(?![\d.])", one, text or "")


@F.pandas_udf(T.StringType())
def snapped_decimals(text: pd.Series) -> pd.Series:
    return text.map(snapped, na_action="ignore")


_MONTHS = {r: str(i + 1) for i, r in enumerate("I II III IV V VI VII VIII IX X XI XII".split())}


def roman_months(text: Column) -> Column:
    """`month VII` as `month 7`; the longest numerals first."""
    return fold(text, [(rf"(?i)\b(month)\s+{r}\b", f"$1 {n}") for r, n in sorted(_MONTHS.items(), key=lambda x: -len(x[0]))])


# small kernels of the record families

#: Marks of a tablet's sides, the letters of words, case endings, and signs that become digits.
SIDE_MARK = r"(?:obv\.?|rev\.?|l\.e\.?|u\.e\.?|le\.e\.?|re\.e\.?|r\.e\.?|lo\.e\.?|ri\.e\.?)"
WORD_LETTERS = "A-Za-zÀ-ÿḫḪšŠṣṢṭṬ"
CASE_ENDINGS = ("-tám", "-tim", "-tum", "-am", "-im", "-um", "-šu", "-ša", "-ni", "-nu", "-né", "-m")
SMALL_DIGITS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")
TERMINAL = r"(?:[.!?;:]|<gap>)(?:[\"')\]]+)?$"


def plain_space(text: Column) -> Column:
    """One space for white space, no soft hyphens."""
    return F.trim(F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), F.lit("­"), F.lit("")))


def without_side_marks(text: Column) -> Column:
    """Marks of a tablet's sides go wherever they stand by themselves."""
    return plain_space(F.regexp_replace(text, rf"(?Uiu)(?<!\w){SIDE_MARK}(?!\w)\s*", ""))


def joined_brackets(text: Column) -> Column:
    """Square brackets go; what they hold stays joined to its word."""
    return F.regexp_replace(text, r"\[([^\]]*)\]", "$1")


def without_left_prefix(text: Column) -> Column:
    """Line numbers with a side's mark, line numbers, and punctuation at the beginning go."""
    t = F.regexp_replace(text, rf"(?Uiu)^(?:(?:\d+\*?\s+)+)?{SIDE_MARK}\s*", "")
    t = F.regexp_replace(t, r"(?U)^(?:\d+\*?\s+)+", "")
    return plain_space(F.regexp_replace(t, r"(?U)^[.,;:-]+\s*", ""))


def visual_noise(text: Column, target: bool) -> Column:
    """Dashes as hyphens, dots spelled out, stars before letters gone; in a source double angles too."""
    t = F.replace(text, F.lit("­"), F.lit(""))
    t = F.replace(F.regexp_replace(t, "[–—]", "-"), F.lit("…"), F.lit(" ... "))
    t = F.regexp_replace(t, r"\*(?=[A-Za-zÀ-ÿ])", "")
    return plain_space(t if target else F.regexp_replace(t, "<<|>>", ""))


def bare_length(text: Column) -> Column:
    """Characters but white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def page_text(text: Column, most: int = 0) -> Column:
    """A page's text with plain spaces, cut to `most` characters if that is not 0."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(t, 1, most) if most else t


def without_fences(text: Column) -> Column:
    """What stands in a code fence; any other text as it is, without white space at its ends."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n\x0b\x0c"))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return F.when(t.startswith("```"), F.btrim(inner, F.lit(" \t\r\n\x0b\x0c"))).otherwise(t)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{WORD_LETTERS}]+)"), 1)


def first_word(text: Column) -> Column:
    """The first word of letters, in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.get(letter_words(text), F.lit(0))), F.lit(""))


def last_word(text: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(letter_words(text), F.lit(-1))), F.lit(""))


def ends_sentence(text: Column) -> Column:
    """Whether a text ends in a mark or a gap, closing quotes aside."""
    return plain_space(text).rlike(TERMINAL)


def cut_with_note(text: Column, most: int = 8000) -> Column:
    """A text of at most `most` characters, and how many were cut."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("...[truncated "), (F.length(t) - most).cast("string"), F.lit(" chars]")))


def variety_or(variety: Column, default: str = "OA") -> Column:
    """The variety, or the default where none is given."""
    return F.coalesce(F.nullif(F.trim(variety), F.lit("")), F.lit(default))


def adjacent_gaps(text: Column) -> Column:
    """Gaps with nothing but white space between them become one."""
    return F.regexp_replace(text, r"(?U)(<gap>)(?:\s+<gap>)+", "$1")


def without_case(word: Column) -> Column:
    """A word without its case ending: the first of the endings in their order."""
    out = word
    for ending in reversed(CASE_ENDINGS):
        out = F.when(word.endswith(ending), word.substr(F.lit(1), F.length(word) - len(ending))).otherwise(out)
    return out


def safe_stem(stem: Column) -> Column:
    """A stem of two syllables or more."""
    return stem.contains("-")


def plain_token(token: Column) -> Column:
    """A token with digits for signs below the line."""
    return F.translate(F.trim(F.coalesce(token, F.lit(""))), *SMALL_DIGITS)


def entry_stem(word: Column) -> Column:
    """A dictionary's word without its number, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(word), r"(?U)\s+[IVX]+$", "")))


def linked_word(url: Column) -> Column:
    """The word that a dictionary's address asks for; null if it asks for none."""
    return F.when(url.contains("word="), F.trim(F.substring_index(url, "word=", -1)))


def entry_gloss(guide: Column, meaning: Column) -> Column:
    """The guide word, else the first quoted meaning, else empty."""
    return F.coalesce(F.nullif(guide, F.lit("")), F.nullif(F.regexp_extract(F.coalesce(meaning, F.lit("")), '"([^"]+)"', 1), F.lit("")), F.lit(""))


def ordered_lines(lines: Column) -> Column:
    """An array of structs (envelope, column, line, label, text) as text, a line each, in the order of tablets; empty lines are left out."""
    s = F.array_sort(F.transform(lines, lambda x: F.struct(F.coalesce(x["envelope"], F.lit(False)).alias("e"), F.coalesce(x["column"], F.lit("")).alias("c"), F.coalesce(x["line"], F.lit(0)).alias("l"), F.coalesce(x["label"], x["line"].cast("string")).alias("n"), F.trim(x["text"]).alias("t"))))
    return F.array_join(F.transform(F.filter(s, lambda x: F.coalesce(x["t"], F.lit("")) != ""), lambda x: F.concat_ws(" ", x["n"], x["t"])), "\n")


def document_id(path: Column) -> Column:
    """A path's slug and the beginning of its digest; the file's suffix is left out."""
    rel = F.regexp_replace(path, r"\.[^./]+$", "")
    slug = F.btrim(F.regexp_replace(F.replace(rel, F.lit("/"), F.lit("__")), "[^0-9A-Za-z._-]+", "_"), F.lit("._"))
    return F.concat(F.when(slug == "", "document").otherwise(slug), F.lit("__"), F.substring(F.sha1(rel), 1, 10))


#: The name space of addresses, as bytes in hexadecimal.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 identifier of a name: SHA-1 of the name space and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def pair_id(path: Column, page: Column, index: Column, source: Column, target: Column) -> Column:
    """The identifier of a pair of a page."""
    return name_uuid(F.concat_ws("::", path, F.concat(F.lit("page="), page.cast("string")), F.concat(F.lit("pair="), index.cast("string")), source, target))


def task_id(task: Column, number: Column) -> Column:
    """task-000001 for the first."""
    return F.concat(task, F.lit("-"), F.lpad(number.cast("string"), 6, "0"))


def catalogue_key(number: Column) -> Column:
    """A catalogue's number with leading zeros, as its records write it."""
    return F.lpad(F.trim(number.cast("string")), 6, "0")


#: What the prompt's parts begin with.
ECHO_MARKS = ("## HINTS:", "## MONTH:")
ECHO_EXAMPLES, ECHO_PREFIX = "Examples:", "to English:"


def without_echo(text: Column) -> Column:
    """An answer without what it repeats of its prompt: hints after it, examples and the task before it."""
    t = F.coalesce(text, F.lit(""))
    for mark in ECHO_MARKS:
        t = F.substring_index(t, mark, 1)
    last = F.substring_index(F.btrim(t, F.lit(" \t\r\n")), "\n", -1)
    t = F.when(t.startswith(ECHO_EXAMPLES), last).otherwise(t)
    at = F.position(F.lit(ECHO_PREFIX), t)
    return F.btrim(F.when(at > 0, t.substr(at + len(ECHO_PREFIX), F.length(t))).otherwise(t), F.lit(" \t\r\n"))


def escaped_breaks(text: Column) -> Column:
    """A lone n that was a line break becomes white space: before a capital or digit a new line, by itself a space."""
    t = F.regexp_replace(text, r"""(^|[\s"'(\[{])n(?=[A-Z0-9])""", "$1\n")
    return F.regexp_replace(t, "(?<![A-Za-z])n(?![A-Za-z])", " ")


def padded(ids: Column, most: Column, pad: int = 0) -> Column:
    """struct<ids,mask>: an array cut or filled to `most`, and what of it is its own."""
    own = F.slice(ids, 1, most)
    fill = F.greatest(most - F.size(own), F.lit(0))
    return F.struct(F.concat(own, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), fill)).alias("mask"))
