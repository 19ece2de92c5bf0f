"""Screens of a corpus family: predicates over a pair and what is known of its row, each with a name.

A screen is a boolean column, so that a caller may drop, count or keep what it
finds; `reasons` gathers several into one array. Everything is an expression
within the row, but for reasons that belong to a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import GAP, let, squeeze, word_count, words
from quern.operators.filters import damaged_words

# The patterns that the family's screens look for. Java's own classes stand for letters; (?U) makes them Unicode.
EDITORIAL_JUNK = (
    r"Traduction(?:\s+[A-Za-z.]+)?\s*:|T\s*moins\s*et\s*date|T[ée]moins?\s+et\s+date|\blines?\s*\d+\s*[-–—]\s*\d+|"
    r"\b(?:AbB|ARM|YOS|TCL|UET|RA|NABU)\s*[A-Z]*\s*\d+(?:[ ,./-]+\d+)*\b"
)
STRONG_META = (
    r"Traduction(?:\s+[A-Za-z.]+)?\s*:|T moins et date|too broken to be translated|remainder lost|reverse broken|"
    r"rest of the (?:(?:obv|rev)\.?(?: is)?|obverse|reverse)(?: and reverse)? (?:broken|lost|not inscribed)|the standard Late OB greeting formulae|greeting formulae ABCDE"
)
EDITORIAL_META = r"(?:^|[\s(])(?:lines?\s*\d+[^\s)]*|fragmentary|remainder lost|reverse broken|rest of the obverse|rest of the reverse|obv\.|rev\.)"
PLACEHOLDER_NAME = r"\b(?:PN(?:\d+)?|DN|GN|RN)\b"
UGLY_RECOGNITION = r"wwork|officie|epoynmy|goodhealth|corv e|mšallim|shekelI\d+|b n \(|sila\d"
SCHOLARLY_PLACEHOLDER = r"\b(?:[fm]?PN[0-9₀-₉]*|DN[0-9₀-₉]*|GN[0-9₀-₉]*|RN[0-9₀-₉]*|PB)\b"
DANGLING_EDITORIAL = r"\(\s*(?:remainder|rest|beginning|obverse|reverse|fragmentary|too broken|too damaged)[^)]*\)"
BROKEN_TAIL = r"<gap>\s*\.?$|[,;:-]\s*$"
WITNESS_DATE = r"\b(?:witness(?:es)?|date|seal impressions?)\b"
BROKEN_NOTE = r"\(\s*(?:broken|substantial break|seal impressions?|witness(?:es)?|date)\s*\)"
META_ONLY = r"^\s*(?:<gap>\s*)?(?:(?:one|two|three|four|five|\d+)\s+)?(?:witness(?:es)?|date|seal impressions?)\b"
LINE_RANGE = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
FRENCH_START = (
    r"^\s*(?:Dis à|Ainsi\s*\(parle\)|Que\s+Šamaš|En outre\b|Pourquoi as-tu|Je souhaite|Lib[eé]re?\b|Toi qui\b)|"
    r"correspondant\s+au|champs?\s+de\s+leur\s+choix|Ann[ée]e\s+o[ùu]\s+le\s+roi"
)
FRENCH_WORD = (
    r"\b(?:ainsi|parle|pourquoi|arriv[ée]\w*|donn[ée]?\w*|serviteurs?|p[ée]ch[ée]s?|contestes?|venue|toi|moi|libre|champ\b|cris-tu|fasse|"
    r"correspondant|choix|ann[ée]e|entrer|porte|temple)\b"
)
ENGLISH_START = r"\b(?:Say to|Speak to|To [A-ZĀĒĪŌŪṢŠṬḪ][^:]{0,120}\bspeak,\s*thus)\b"
FOREIGN_WORD = (
    r"\b(?:Sekel|Silber|Gerste|Sohn|Gattin|Haus|Jahr|Monat|Schmied|bezahlt|Zeuge|Zeugen|T[ée]moins?|Temoins?|Année|reçu|fils de|fille de|le roi|la ville|dans|avec|pour)\b"
)
#: Domains that a family leaves out, by what a whole document says.
DOMAINS = {
    "royal": (
        r"\b(?:RIME|royal inscription|foundation deposit|statue of himself|offering prayer|dedicated for his life|inscribed for his life|"
        r"brought into the esagila|raised the top of the emeslam|the king established)\b"
    ),
    "cultic": (
        r"\b(?:daily offerings?|food offerings?|offering of wool|morning and evening offering|flour offering|aširtum offering|sirqum offering|funerary offering|"
        r"new moon celebration|full moon celebration|sacrifice(?: for)?|food allocations? of the temple|food allocation of the temple|property of \(god\)|property of god|"
        r"large old temple|temple complex|harp\(-songs\)|banquet\b|festival(?:s)?|eššešum|full moon celebration|nešakkum(?:-officials?)?|pašīšum(?:-priests?)?|"
        r"chief lamentation priest|lamentation singers?|priest(?:s)?\b|temple of|the temple of|guennakkum)\b"
    ),
    "literary": r"\b(?:hymn(?:s)?|incantation(?:s)?|proverb(?:s)?|literary|dialogue|balag|ershema)\b",
    "divination": r"\b(?:omen(?:s)?|oracle(?:s)?|divination|extispic(?:y)?|omen-consultation|purification rite)\b",
    "school": r"\b(?:school(?: exercise)?|copybook|student(?: exercise)?|lexical list|school tablet|exercise tablet|model letter)\b",
    "editorial_commentary": r"(?:Maybe a fragment of a model trial|This text is heavily damaged|Only the beginning and the date can be read|less cursive handwriting|Translation\s*\(composite\))",
    "lexical_gloss": r"\((?:cloth|clothes|garment|garments|wood|stone|metal)\)\s+[A-Za-zĀāĒēĪīŌōŪūṢṣŠšṬṭḪḫ'\-]+",
}
#: Of pages read by recognition: what marks commentary, tokens of a source, and words of a translation.
COMMENTARY = (
    r"\b(?:cf\.|see now|improved readings|variant|variants|study of the original|missing in|through damage|still visible|erased|erasure|damage|restored|"
    r'comment|comments|bibliography|line[s]?|translation "|translation "|meaning|occurs|archive|register|registers)\b'
)
SOURCE_TOKEN = r"""(?:\b[0-9]+\b|\b[A-Z]{2,}(?:\.[A-Z]+)*\b|\{[a-z]+\}|[A-Za-záàéèíìúùšṣṭḫŠṢṬḪ"!#$%&('/]+-[A-Za-záàéèíìúùšṣṭḫŠṢṬḪ0-9"!#$%&('/]+)"""
QUANTITY = (
    r"\b(?:\d+(?:[¼½¾⅓⅔])?|¼|½|¾|⅓|⅔|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty|thirty|forty|fifty|sixty)"
    r"\s+(?:mina|minas|shekel|shekels|talent|talents)\b"
)
TARGET_NAME = r"\b[A-ZĀĒĪŪŠṢṬḪ][A-Za-zĀāĒēĪīŪūŠšṢṣṬṭḪḫÇçȘșȚț'’-]+\b"
COMMODITY = r"\b(?:ma-na|GÍN|GÚ|AN\.NA|URUDU|KÙ\.BABBAR|KÙ\.B\.?|TÚG(?:\.HI\.A)?|ANŠE(?:\.HI\.A)?)\b"
SPOKEN_COMMODITY = r"\bum-ma\s+(?:ma-na|GÍN|GÚ|KÙ\.BABBAR|KÙ\.B\.?|AN\.NA|URUDU|TÚG)\b"
CAPITALS = "A-ZŠṢṬḪÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ"
STOP_WORDS = "the have for of from these in with to has should will and that this had those would".split()
SIGNAL_WORDS = (
    "say owed been given their are received made bought being your had be sealed placed entrusted give my took refused his returned arrived settled left has "
    "claimed gave send paid if take deposited owe brought added wrote testified ordered would was declared confirmed divided demanded sent witnessed says owes "
    "delivered collected were invested should her came asked sold entitled answered promised told thus went bring receive have agreed shall pay swore died our "
    "assisted appealed will is contracted"
).split()
TRADE_WORDS = (
    "mina minas shekel shekels talent talents silver gold tin textile textiles kutānu colony palace tablet seal eponym eponymy son daughter wife father mother brother "
    "caravan donkey donkeys merchandise goods"
).split()
OPENING_STOP = "to from thus say and as the".split()
OPENING_SKIP = "a-na qí-bi-ma qi-bi-ma qí-bi4-ma qi-bi4-ma um-ma ù u ša".split()
ODD_SYMBOLS = "[γβµ]"
#: Files that serve to go on with training alone.
RESUME_FILES = ("dataset-metadata.json", "optimizer.pt", "scheduler.pt", "scaler.pt", "trainer_state.json")


def has(text: Column, pattern: str, any_case: bool = True) -> Column:
    """Whether a pattern occurs; false for a null text."""
    return F.coalesce(text.rlike(f"(?U{'iu' if any_case else ''}){pattern}"), F.lit(False))


def occurrences(text: Column, pattern: str, any_case: bool = True) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U{'iu' if any_case else ''}){pattern}")), F.lit(0))


def gaps(text: Column) -> Column:
    return occurrences(text, GAP, any_case=False)


def size(text: Column) -> Column:
    """Words, one at least."""
    return F.greatest(word_count(text), F.lit(1))


def gap_density(source: Column, target: Column) -> Column:
    return (gaps(source) + gaps(target)) / (size(source) + size(target))


def fragmentary(source: Column, target: Column) -> Column:
    """Pairs that are mostly damage or editors' remarks, by six signs."""
    g, n, both = gaps(target), size(target), gap_density(source, target)
    return (
        has(target, STRONG_META)
        | (has(target, PLACEHOLDER_NAME, any_case=False) & ((g >= 1) | (n <= 18)))
        | (has(target, EDITORIAL_META) & (both >= 0.18))
        | (both >= 0.38)
        | ((g / n >= 0.22) & (n <= 24))
        | (has(target, UGLY_RECOGNITION) & (g >= 1))
    )


def residual_editorial(target: Column) -> Column:
    """Editors' remarks that cleaning left in a damaged or short target."""
    return has(target, EDITORIAL_JUNK) & ((gaps(target) / size(target) >= 0.18) | (size(target) <= 18))


def fragment_signs(source: Column, target: Column, align_type: Column) -> dict[str, Column]:
    """Named signs of a fragment; a grouped document may hold more of them than a sentence."""
    g, n = gaps(target), size(target)
    grouped = F.coalesce(F.lower(align_type) == "doc_grouped", F.lit(False))

    def times(mark: str) -> Column:
        return F.length(target) - F.length(F.replace(target, F.lit(mark), F.lit("")))

    return {
        "many_gaps": g >= F.when(grouped, 5).otherwise(3),
        "dense_fragment": gap_density(source, target) >= 0.15,
        "dangling_editorial": has(target, DANGLING_EDITORIAL),
        "quote_imbalance": times('"') % 2 != 0,
        "paren_imbalance": times("(") != times(")"),
        "long_fragment": F.when(grouped, (n >= 100) & (g >= 3)).otherwise((n >= 60) & (g >= 1)),
        "broken_tail": has(target, BROKEN_TAIL) & (g >= 1),
    }


def is_sentence(align_type: Column) -> Column:
    return F.coalesce(F.lower(align_type) == "sentence", F.lit(False))


def sentence_metadata(target: Column, align_type: Column) -> Column:
    """Sentences that are a list of witnesses, a date or a seal."""
    about = has(target, WITNESS_DATE) | has(target, BROKEN_NOTE) | has(target, META_ONLY)
    return is_sentence(align_type) & about & ((size(target) <= 18) | target.contains(GAP))


def has_placeholder(*texts: Column) -> Column:
    """Whether any text still has a scholar's placeholder for a name; null texts have none."""
    out = F.lit(False)
    for t in texts:
        out = out | has(t, SCHOLARLY_PLACEHOLDER, any_case=False)
    return out


def single_line_sentence(source: Column, target: Column, align_type: Column, line_ref: Column) -> Column:
    """Sentences of one line of the source whose target is a whole clause."""
    first, last = (F.regexp_extract(line_ref, LINE_RANGE, i) for i in (1, 2))
    s, t = size(source), size(target)
    return is_sentence(align_type) & F.coalesce((first != "") & (first == last), F.lit(False)) & (((s <= 1) & (t >= 7)) | ((s <= 2) & (t >= 12)))


def french(text: Column) -> Column:
    """A sure beginning, or four French words."""
    return has(F.trim(text), FRENCH_START) | (occurrences(text, FRENCH_WORD) >= 4)


def english_tail(text: Column) -> Column:
    """What follows a known English opening, that included; empty where there is none."""
    tail = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?Us)({ENGLISH_START}.*)", 1)
    return F.btrim(tail, F.lit(" \t\n\r-;:,"))


def repaired_or_dropped(df: DataFrame, key: str, text: str, answer: str | None = None) -> DataFrame:
    """French targets give way to their English tail or to a recorded answer; ids for which there is neither go whole.

    An answer that is empty or says to drop is none. Adds `french_state`:
    kept, recovered or repaired.
    """
    t, tail = F.coalesce(F.col(text), F.lit("")), english_tail(F.col(text))
    head = t.substr(F.lit(1), F.greatest(F.position(tail, t) - 1, F.lit(1)))
    fixed = F.trim(F.coalesce(F.col(answer), F.lit(""))) if answer else F.lit("")
    usable = (fixed != "") & (fixed != "<DROP>")
    state = F.when((tail != "") & french(head), "recovered").when(~french(t), "kept").when(usable, "repaired").otherwise("drop")
    d = df.withColumn("french_state", state)
    gone = d.where("french_state = 'drop'").select(F.col(key).alias("gone_key")).distinct()
    d = d.join(gone, F.col(key).eqNullSafe(F.col("gone_key")), "left_anti")
    return d.withColumn(text, F.when(F.col("french_state") == "recovered", english_tail(F.col(text))).when(F.col("french_state") == "repaired", fixed).otherwise(F.col(text)))


def foreign(text: Column) -> Column:
    """Two words of other languages' editions."""
    return occurrences(text, FOREIGN_WORD) >= 2


def high_damage(target: Column, variety: Column) -> Column:
    """Short targets with a gap, or of mostly cut words, in the variety that is judged so."""
    return F.coalesce(variety == "OA", F.lit(False)) & (((F.length(target) < 60) & (gaps(target) >= 1)) | (damaged_words(target) > 0.3))


def confident_answer(score: Column, source: Column, target: Column, strategy: Column, log_probability: float = -1.5, agreement: float = 55.0, low: float = 0.6, high: float = 2.0) -> Column:
    """Answers worth keeping: the score of a beam is a log-probability, that of a choice an agreement; and a plausible ratio of characters."""
    r = F.length(target) / (F.length(source) + F.lit(1e-9))
    return (score >= F.when(strategy == "beam", log_probability).otherwise(agreement)) & r.between(low, high)


# pages read by recognition


def source_tokens(text: Column) -> Column:
    return F.regexp_extract_all(squeeze(text), F.lit(f"(?U)({SOURCE_TOKEN})"), 1)


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), 1)


def reads_like_source(text: Column) -> Column:
    """At least two tokens of the source's kind, less than half of them stop words, and no commentary."""

    def judged(w: Column) -> Column:
        return (F.size(w) >= 2) & (F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))) < F.size(w) * 0.5)

    t = squeeze(text)
    return (t != "") & ~has(t, COMMENTARY) & let(source_tokens(text), judged)


def reads_like_target(text: Column) -> Column:
    """Three words or more, no commentary, years or slashes, and a sign of the genre: a usual word, an opening, or marked vowels."""
    t = squeeze(text)

    def count_of(w: Column, known: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: F.lower(x).isin(known)))

    def judged(w: Column) -> Column:
        n = F.size(w)
        return (n >= 3) & (
            (F.lower(F.get(w, F.lit(0))) == "witnessed")
            | (count_of(w, SIGNAL_WORDS) >= 1)
            | (t.rlike("^[0-9\"']") & (n >= 6))
            | ((n >= 5) & (count_of(w, TRADE_WORDS) >= 1))
            | t.startswith("Thus ")
            | t.startswith("Say to ")
            | (t.rlike("[āēīūṣṭ]") & (n >= 4))
        )

    return (t != "") & ~has(t, COMMENTARY) & ~t.rlike(r"(?U)\b\d{4}\b|[A-Za-z][/\\][A-Za-z]") & F.coalesce(let(latin_words(t), judged), F.lit(False))


def target_opening_names(text: Column) -> Column:
    """Capitalised names before the first full stop, colon or quantity."""
    opening = F.split(F.split(text, r"[.:;]", 2)[0], f"(?Uiu){QUANTITY}", 2)[0]
    return F.filter(F.regexp_extract_all(opening, F.lit(f"(?U)({TARGET_NAME})"), 1), lambda x: ~F.lower(x).isin(OPENING_STOP))


def source_opening_names(text: Column) -> Column:
    """Hyphenated words with a capital before the first commodity."""
    opening = F.split(text, f"(?U){COMMODITY}", 2)[0]
    bare = F.transform(words(opening), lambda x: F.btrim(x, F.lit(",:;[]()<>")))
    return F.filter(bare, lambda x: x.contains("-") & ~F.lower(x).isin(OPENING_SKIP) & x.rlike(f"[{CAPITALS}]"))


def opening_mismatch(source: Column, target: Column) -> Column:
    """Letters whose target names three people or more at its opening and whose source names one at most, or speaks of goods."""
    letter = F.coalesce(target.rlike(r"(?U)^(?:To|From)\b"), F.lit(False))
    return letter & (F.size(target_opening_names(target)) >= 3) & ((F.size(source_opening_names(source)) <= 1) | has(source, SPOKEN_COMMODITY, any_case=False))


def candidate_reason(source: Column, target: Column) -> Column:
    """The first reason to reject a candidate pair of a page; null keeps it."""
    return (
        F.when(~reads_like_source(source), "weak_transliteration")
        .when(~reads_like_target(target), "weak_translation")
        .when(F.size(latin_words(target)) < 3, "translation_too_short_words")
        .when(opening_mismatch(source, target), "letter_opening_name_mismatch")
        .when(source.rlike(ODD_SYMBOLS), "unexpected_ocr_symbols")
    )


# pools


def clean_example(source: Column, target: Column, least: int = 20, prefix: int = 0) -> Column:
    """Examples fit to be shown: a target long enough, without a gap or much repetition, and a source beyond its prefix."""
    varied = let(words(target), lambda w: (F.size(w) <= 3) | (F.size(F.array_distinct(w)) / F.size(w) >= 0.3))
    return (F.length(target) >= least) & ~F.lower(target).contains(GAP) & (F.trim(target) != "") & (F.length(F.trim(source)) > prefix + 5) & varied


def translation_pool(source: Column, target: Column, uncertainty: Column | None = None) -> Column:
    """Whole pairs: neither side is empty or has a gap, and nothing is uncertain."""
    out = (source != "") & (target != "") & ~source.contains(GAP) & ~target.contains(GAP)
    return out if uncertainty is None else out & (F.coalesce(uncertainty.cast("string"), F.lit("")) == "")


def segmentation_pool(source: Column, target: Column) -> Column:
    """Short whole sentences: 2 to 24 words, at most 160 characters."""
    return word_count(source).between(2, 24) & (F.length(source) <= 160) & translation_pool(source, target)


def upload_excluded(path: Column) -> Column:
    """Files of a folder that serve to go on with training alone."""
    name = F.substring_index(path, "/", -1)
    return name.isin(*RESUME_FILES) | name.rlike(r"^rng_state(?:_[0-9]+)?\.(?:pth|pt)$")


# reasons


def reasons(**screens: Column) -> Column:
    """The names of the screens that find a row, in their order."""
    return F.array_compact(F.array(*[F.when(found, F.lit(name)) for name, found in screens.items()]))


def document_reasons(df: DataFrame, document: str, order: list[str], columns: list[str], domains: dict[str, str] = DOMAINS, reach: int = 4) -> DataFrame:
    """(document, reasons): why whole documents are left out, by the values of their rows in order, joined by commas.

    A pattern may reach over the ends of values: a row is read with the
    `reach` rows after it, each column by itself. So no document is gathered
    in one place, and one found anywhere is found once.
    """
    w = Window.partitionBy(document).orderBy(*order).rowsBetween(0, reach)
    found = {name: F.lit(False) for name in domains}
    for c in columns:
        text = F.array_join(F.filter(F.collect_list(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).over(w), lambda x: x != ""), " ")
        found = {name: was | has(text, domains[name]) for name, was in found.items()}
    d = df.select(document, *[x.alias(name) for name, x in found.items()]).groupBy(document).agg(*[F.bool_or(name).alias(name) for name in domains])
    d = d.select(document, F.array_join(reasons(**{name: F.col(name) for name in domains}), ",").alias("reasons"))
    return d.where("reasons <> ''")


def with_document_reasons(df: DataFrame, document: str, found: DataFrame) -> DataFrame:
    """Adds `drop_reason` to the rows of documents that have one; a left join."""
    f = found.select(F.col(document).alias("found_document"), F.col("reasons").alias("drop_reason"))
    return df.join(f, F.col(document).eqNullSafe(F.col("found_document")), "left").drop("found_document")
