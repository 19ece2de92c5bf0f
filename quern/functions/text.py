"""Text normalisers as column expressions.

A rule set is a list of (pattern, replacement) in an order that matters,
folded into nested regexp_replace calls, so that everything stays in the JVM.
Patterns are written for Unicode classes: `(?U)` stands before each.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = list[tuple[str, str]]
GAP = "<gap>"


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once a row: a lambda's variable is not evaluated again where it is named again."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def fold(text: Column, rules: Rules, flags: str = "U") -> Column:
    """The rules one after the other; null becomes empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for pattern, replacement in rules:
        out = F.regexp_replace(out, f"(?{flags}){pattern}", replacement)
    return out


#: White space but for the plain space, spelled out: the same characters as the Unicode class, several times faster.
_SPACES = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, which most are, match nothing."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[ {_SPACES}]{{2,}}|[{_SPACES}]", " "))


def words(text: Column) -> Column:
    """The words between white space; none for an empty text."""
    return let(squeeze(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def decode_escapes(text: Column) -> Column:
    """Spelled-out line feeds and tabs become white space."""
    t = F.coalesce(text, F.lit(""))
    for spelled, real in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\n"), ("\\t", " ")):
        t = F.replace(t, F.lit(spelled), F.lit(real))
    return t


#: The spellings of damage that become one gap token. The order is part of the rules.
GAP_SPELLINGS: Rules = [
    (r"<\s*(?:big|small)_gap\s*>", f" {GAP} "),
    (r"\bbig_gap\b", f" {GAP} "),
    (r"\{large\s+break\}", f" {GAP} "),
    (r"\(broken\s+lines?\)", f" {GAP} "),
    (r"\d+\s+broken\s+lines?", f" {GAP} "),
    (r"\[\s*(?:\.{3,}|…+)\s*\]", f" {GAP} "),
    (r"\(\s*(?:\.{3,}|…+)\s*(?:lacunae?|break(?:en)?(?:\s+lines?)?)?\s*\)", f" {GAP} "),
    (r"\(\s*lacunae?\s*\)", f" {GAP} "),
    (r"…+", f" {GAP} "),
    (r"\.{3,}", f" {GAP} "),
    (r"x{3,}", f" {GAP} "),
    (r"\bx(?:\s+x){2,}\b", f" {GAP} "),
    (r"\(x\)|\[x\]", f" {GAP} "),
]
_LONE_X = r"(?<![a-zA-Z\-₀-₉])x(?![a-zA-Z\-₀-₉])"


def unify_gaps(text: Column) -> Column:
    """Every spelling of damage as the gap token; neighbouring tokens merge; a space beside it unless a hyphen binds it."""
    t = fold(text, GAP_SPELLINGS, "iU")
    t = fold(t, [(_LONE_X, f" {GAP} ")])
    t = fold(
        t,
        [
            (rf"{GAP}(?:[\s\-.]*{GAP})+", GAP),
            (r"\s+", " "),
            (rf"(?<![-\s]){GAP}", f" {GAP}"),
            (rf"{GAP}(?![-\s])", f"{GAP} "),
            (rf"-\s+{GAP}", f"-{GAP}"),
            (rf"{GAP}\s+-(?=\S)", f"{GAP}-"),
            (rf"{GAP}\s+([.,;:!?])", f"{GAP}$1"),
        ],
        "iU",
    )
    return squeeze(t)


#: Fractions by name, by decimals (cut short or not) and by numerator and denominator.
FRACTION_NAMES = {r"one[\s-]+half": "½", r"one\s+third": "⅓", r"two\s+thirds": "⅔", r"one\s+(?:fourth|quarter)": "¼", r"three\s+fourths": "¾"}
FRACTION_DECIMALS = {"125": "⅛", "375": "⅜", "625": "⅝", "875": "⅞", "25": "¼", "75": "¾", "5": "½", r"83(?:3+\d*)?": "⅚", r"6(?:6(?:6+\d*)?)?": "⅔", r"3(?:3(?:3+\d*)?)?": "⅓", r"16(?:6+\d*)?": "⅙"}
FRACTION_PARTS = {(1, 2): "½", (1, 3): "⅓", (2, 3): "⅔", (1, 4): "¼", (3, 4): "¾", (1, 5): "⅕", (1, 6): "⅙", (5, 6): "⅚", (1, 8): "⅛", (3, 8): "⅜", (5, 8): "⅝", (7, 8): "⅞"}


def unify_fractions(text: Column) -> Column:
    """Fractions in words, decimals and n/m as one sign, with a space after a whole number."""
    t = fold(text, [(rf"\b{p}\b", v) for p, v in FRACTION_NAMES.items()], "iU")
    t = fold(t, [(rf"\b0\.{p}\b", v) for p, v in FRACTION_DECIMALS.items()] + [(r"(?<!\d)\.5\b", "½")])
    t = fold(t, [(rf"\b(\d+)\.{p}\b", f"$1 {v}") for p, v in FRACTION_DECIMALS.items()])
    t = fold(t, [(rf"\b{a}\s*/\s*{b}\b", v) for (a, b), v in FRACTION_PARTS.items()])
    return fold(t, [(r"(\d)([½¼¾⅓⅔⅙⅚⅛⅜⅝⅞])", "$1 $2")])


def plain_digits(text: Column) -> Column:
    """Subscript and superscript digits as ordinary ones."""
    return F.translate(F.coalesce(text, F.lit("")), "₀₁₂₃₄₅₆₇₈₉ₓ⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789x0123456789")


_ACCENTS = {"a": "áà", "e": "éè", "i": "íì", "u": "úù"}


def index_accents(text: Column) -> Column:
    """A vowel with index 2 or 3 as the vowel with acute or grave."""
    t = F.coalesce(text, F.lit(""))
    for v, marks in _ACCENTS.items():
        for n, mark in zip("23", marks, strict=True):
            sub = "₂₃"["23".index(n)]
            t = F.regexp_replace(t, f"{v}[{n}{sub}]", mark)
            t = F.regexp_replace(t, f"{v.upper()}[{n}{sub}]", mark.upper())
    return t


def ascii_letters(text: Column) -> Column:
    """Two-character spellings of sibilants and emphatics as one letter."""
    t = F.coalesce(text, F.lit(""))
    for a, b in (("sz", "š"), ("SZ", "Š"), ("s,", "ṣ"), ("S,", "Ṣ"), ("t,", "ṭ"), ("T,", "Ṭ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; there is no built-in function for it."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """Letters without their combining marks; what has no ASCII letter below it becomes a space."""

    def one(t: str) -> str:
        return "".join(c if ord(c) < 128 else " " for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")

    return text.map(one, na_action="ignore")


def allow(text: Column, characters: str) -> Column:
    """Only the given characters and single spaces; every other becomes a space."""
    inside = "".join("\\" + c if c in "\\]^-[&" else c for c in dict.fromkeys(characters))
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{inside}]", " "))


def strip_html(html: Column) -> Column:
    """Text without tags, common character references decoded, white space squeezed."""
    t = fold(html, [(r"(?s)<[^>]+>", "")])
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return squeeze(t)


def compare_form(text: Column) -> Column:
    """Lower case, everything but letters and digits as a space."""
    return squeeze(fold(F.lower(text), [(r"[^\p{L}\p{N}]+", " ")]))


def drop_repeated_words(text: Column) -> Column:
    """A word said several times in a row is said once."""
    return fold(text, [(r"\b(\w+)(?:\s+\1\b)+", "$1")])


def collapse_phrases(ws: list[str], longest: int = 8, shortest: int = 2) -> list[str]:
    """Of neighbouring equal phrases one stays, the longest phrases first."""
    for n in range(longest, shortest - 1, -1):
        kept: list[str] = []
        i = 0
        while i < len(ws):
            phrase = ws[i : i + n]
            j = i + n
            if len(phrase) == n and ws[j : j + n] == phrase:
                while ws[j : j + n] == phrase:
                    j += n
                kept += phrase
                i = j
            else:
                kept.append(ws[i])
                i += 1
        ws = kept
    return ws


@F.pandas_udf(T.StringType())
def drop_repeated_phrases(text: pd.Series) -> pd.Series:
    """Neighbouring equal phrases of 2 to 8 words; short texts stay as they are."""
    return text.map(lambda t: t if len(t) < 10 or len(t.split()) < 4 else " ".join(collapse_phrases(t.split())), na_action="ignore")


def trim_fragment(text: Column, longer_than: int = 100) -> Column:
    """A long text that ends in a letter ends at its last sentence mark instead."""
    t = F.rtrim(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(t, r"(?s)^(.*(?:[.?!]'|[.?!]))", 1)
    return F.when((F.length(t) > longer_than) & t.rlike(r"(?U)\p{L}$") & (cut != ""), cut).otherwise(t)


def line_prefixes(text: Column) -> Column:
    """Line numbers stuck to the start of a line's first word."""
    return fold(text, [(r"(?m)^[ \t]*(?:[a-z]{1,3}-[0-9IlSs]{1,3}(?:-[0-9IlSs]{1,3})?\s*|[0-9IlSs]{1,3}-[0-9IlSs]{1,3}\s*|[0-9IlSs]{1,3})(?=[A-Z\[])", "")])


def heal_line_breaks(text: Column) -> Column:
    """Words and names split by a line's end or by a space at their hyphen."""
    return fold(text, [(r"(?<=\p{L})\s*\n\s*(?=\p{Ll})", " "), (r"(?<=\p{L})-\s+(?=\p{L})", "-"), (r"\b(\p{L}{1,4})\s+-\s*(?=\p{L})", "$1-")])


def editorial_notes(text: Column) -> Column:
    """Parentheses that hold an editor's preference, alternative or variant."""
    return fold(text, [(r"\(\s*(?:(?:[A-Za-z][A-Za-z\-]*\s+)?preference|preferred(?:\s+translation)?|alternative|variant)\s*:?\s*[^)]*\)", " ")], "iU")


def join_brackets(text: Column) -> Column:
    """What square brackets hold, without them; brackets around damage become a gap."""
    return fold(text, [(r"\[(?:[.…xX\-–—\s])+\]", f" {GAP} "), (r"\[([^\[\]\n]{0,48})\]", "$1")])


def source_noise(text: Column) -> Column:
    """Marks of modern editions in a source text; the gap token stays."""
    t = fold(text, [(r"(?i)\((?:space|blank|vacat)\)", " "), (r"[⸢⸣⸤⸥⌈⌉˹˺\[\]()!?/:［］（）【】]", ""), (r"<(?!gap>)|(?<!<gap)>", ""), (r"_", " "), (r"(?i)\b(?:space|blank|vacat)\b", " "), (r"\s*-\s*", "-"), (r"(?<=\w)\s*\.\s*(?=\w)", ".")])
    return squeeze(t)


def clean_source(text: Column) -> Column:
    """The whole chain for source texts."""
    t = plain_digits(index_accents(ascii_letters(decode_escapes(text))))
    return unify_gaps(source_noise(unify_gaps(unify_fractions(t))))


def clean_target(text: Column) -> Column:
    """The whole chain for target texts."""
    t = unify_fractions(unify_gaps(editorial_notes(line_prefixes(decode_escapes(text)))))
    return heal_line_breaks(unify_gaps(t))


def postprocess(text: Column) -> Column:
    """A model's output: gaps, fractions and digits in one form, repeats gone."""
    t = fold(text, [(rf"(?i)(?<!-){GAP}(?:\s*{GAP})+(?!-)", GAP), (r"<(?!gap>)|(?<!<gap)>|[⌈⌋⌊\[\]+ʾ]", "")])
    return squeeze(drop_repeated_phrases(drop_repeated_words(unify_fractions(plain_digits(t)))))


def mask(text: Column, pattern: str, change) -> Column:
    """`change` applied to everything but the matches of `pattern`, which stay as they are."""
    mark = "\u0001"
    held = F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), 1)
    parts = F.split(change(fold(text, [(f"(?:{pattern})", mark)])), mark, -1)
    return F.array_join(F.zip_with(parts, held, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def roman(text: Column) -> Column:
    """The value of a Roman numeral of up to 3999; null for any other text."""
    t = F.upper(F.trim(text))
    total = F.lit(0)
    for sign, value in (("CM", 900), ("CD", 400), ("XC", 90), ("XL", 40), ("IX", 9), ("IV", 4)):
        total = total + F.when(t.contains(sign), value).otherwise(0)
    rest = F.regexp_replace(t, "CM|CD|XC|XL|IX|IV", "")
    for sign, value in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)):
        total = total + value * (F.length(rest) - F.length(F.replace(rest, F.lit(sign), F.lit(""))))
    return F.when(t.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (t != ""), total)


def preview(text: Column, limit: int) -> Column:
    """At most `limit` characters, then an ellipsis if any are missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def text_id(*columns: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the columns joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, digits)
