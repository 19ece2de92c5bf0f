"""Rules of single editions and stages on top of the general ones: tables of what to replace, folded into one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.records import SIDE_MARK, escaped_breaks, without_echo
from quern.functions.text import GAP, Rules, clean_source, clean_target, decode_escapes, fold, postprocess, squeeze

# Letters with dots below as editions spell them, characters that are noise, and decimals that one corpus writes.
DOTTED = (("ș", "ṣ"), ("Ș", "Ṣ"), ("ş", "ṣ"), ("Ş", "Ṣ"), ("ț", "ṭ"), ("Ț", "Ṭ"))
DOTLESS = (("ı", "i"), ("İ", "I"), ("ą", "a"), ("ų", "u"), ("∪", "U"))
NOISE = "¯′™ª°τ"
RAISED, RAISED_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
CORPUS_DECIMALS = (("0.33333", "⅓"), ("0.66666", "⅔"), ("0.5", "½"), ("0.25", "¼"), ("0.75", "¾"), ("1.5", "1½"), ("2.5", "2½"), ("3.5", "3½"))
QUOTES = (("«", '"'), ("»", '"'), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"))
COMMA_LETTERS = (("S,", "Ṣ"), ("T,", "Ṭ"), ("s,", "ṣ"), ("t,", "ṭ"))
VOWELS = "a-záàéèíìúùāēīū"
ASIDES: Rules = [(r"\([^)]*\?[^)]*\)", ""), (r"(?i)\((?:i\.e\.|seal impression|lines? \d|broken|colophon|erasure|uninscribed)[^)]*\)", "")]
EXAMPLE_SEPARATOR = " || "
LAYOUT_MARK = (r"(?i)(?:(?<=^)|(?<=\s))(?:obv\.|rev\.|l\.e\.|u\.e\.|le\.e\.|re\.e\.)(?=\s|$)", " ")
LINE_NUMBER = (r"(?m)^[^\S\n]*\d+(?:-\d+)?\*?[^\S\n]*", "")


def spelt(text: Column, table) -> Column:
    """Each spelling by the other, one after the other."""
    out = F.coalesce(text, F.lit(""))
    for old, new in table:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def corpus_source(text: Column) -> Column:
    """The general chain, and then the corpus's decimals and digits below the line."""
    return F.translate(spelt(clean_source(text), CORPUS_DECIMALS), "₀₄₅₆₇₈₉", "0456789")


def corpus_target(text: Column) -> Column:
    """The general chain without brackets of any kind: supplements stay, corrections and asides go, letters get their dots."""
    t = fold(clean_target(text), [(r"\[([^\]]*)\]", "$1"), (r"<(?!gap\b)([^<>]+)>", "$1"), (r"<<[^<>]+>>", "")])
    t = fold(t, [(rf"{old}(?=[{VOWELS}])", new) for old, new in COMMA_LETTERS] + ASIDES)
    return squeeze(fold(t, [(r"\(([^)]{1,80})\)", "$1"), (r"\.\.+", ".")]))


def light(text: Column) -> Column:
    """What a text needs before it is aligned: plain quotes and dashes, no soft hyphens, line ends or slashes at hyphens."""
    t = fold(spelt(decode_escapes(text), (("­", ""), *QUOTES)), [LAYOUT_MARK, LINE_NUMBER])
    return squeeze(spelt(t, (("\n", " "), ("-/", ""), ("/-", ""))))


def light_target(text: Column) -> Column:
    """The same for a target: lone line-break letters first, then no space before punctuation and no brace at the end."""
    t = light(escaped_breaks(decode_escapes(text)))
    return squeeze(fold(t, [(r"\s+([,.;:?!])", "$1"), (r"\s*\}\s*$", "")]))


def broken_braces(text: Column) -> Column:
    """A determinative that breaks off is a gap; empty braces go."""
    return fold(text, [(rf"(?i)\{{[a-z]+-\s*{GAP}", GAP), (r"\{[a-zA-Z]+-(?=\s|$)", GAP), (r"\{\s*\}", "")])


def answer_only(text: Column) -> Column:
    """An answer without what it repeats of its prompt, examples before a separator included."""
    t = F.coalesce(text, F.lit(""))
    for mark in ("## HINTS:", "## MONTH:"):
        t = F.substring_index(t, mark, 1)
    return without_echo(F.substring_index(t, EXAMPLE_SEPARATOR, -1))


def evaluated(text: Column) -> Column:
    """The form in which answers and references are compared."""
    return without_echo(postprocess(text))


def read_source(text: Column) -> Column:
    """A source as recognition spells it: dotted letters, divine determinatives, dots of damage, and line ends within words."""
    t = F.translate(spelt(text, (*DOTTED, *DOTLESS)), RAISED + NOISE, RAISED_DIGITS)
    return fold(t, [(r"(?:đ|dτ)(?=[A-Z])", "{d}"), (r"-/\s*", "-"), (r"(?<!\.)\.{2,}(?!\.)", f" {GAP} "), (r"(?i)(?<!\w)(?:lo\.e\.?|ri\.e\.?)(?!\w)", " ")])


def read_target(text: Column) -> Column:
    """A target without raised digits and without marks of a tablet's sides, line numbers before them included."""
    side = f"(?:{SIDE_MARK[3:-1]}|e\\.|r\\.)"
    return fold(F.translate(text, RAISED + "ª°", ""), [(rf"(?i)(?<!\w)\d+\s*{side}(?!\w)\s*", " "), (rf"(?i)(?<!\w){side}(?!\w)", " ")])


def page_line(text: Column, least: int = 10, header: str = r"^\s*(?:\d+|[IVXLC]+)\s*$") -> Column:
    """A page's text without control characters; empty if it is short or a header."""
    t = squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.when((F.length(t) < least) | t.rlike(header), "").otherwise(t)
