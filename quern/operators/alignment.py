"""Validation of proposed sentence alignments: hard constraints first, the first failure is the reason."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"\d+(?:[./]\d+)?[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞]?|[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞]")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|<gap>")
_NUMERIC_GAP = re.compile(r"(?:\d|[½⅓⅔¼¾⅚⅙])\s*<gap>|<gap>\s*(?:ma-na|gín|gin2|gú|shekel|mina|talent)", re.I)
#: Words at which a sentence cannot end, at which one rarely starts, and that are English wherever they stand.
HANGING = frozenset(
    "a an and as at because by for from if in into is my of on or our since that the their then these this those to we when while with without your".split()
)
MIDDLE = HANGING | {"don't", "not", "there"}
ENGLISH = (
    "about after and because before between could during from have into should the that their there them then these this those through under upon were which while with without would".split()
)
ESCAPE = re.compile(r"""(^|[\s"'(\[{])n(?=[A-Z0-9])""")
TERMINAL = re.compile(r"""(?:[.!?;:]|<gap>)(?:["')\]]+)?$""")
LETTERS = re.compile("[A-Za-zÀ-ÿḫḪšŠṣṢṭṬ]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def marks(text: str) -> str:
    """The letters with diacritics in order: they tell silent edits."""
    return "".join(c for c in text if ord(c) > 127 and unicodedata.category(c)[0] == "L")


def overlap(source: str, candidate: str) -> tuple[float, float, int]:
    """(recall, precision, shared) of word tokens, counting repeats; a side without tokens counts as whole."""
    a, b = Counter(tokens(source)), Counter(tokens(candidate))
    shared = sum((a & b).values())
    return shared / a.total() if a else 1.0, shared / b.total() if b else 1.0 if not a or not candidate.strip() else 0.0, shared


def edit_counts(source: str, candidate: str) -> tuple[int, int]:
    """Words inserted and deleted."""
    a, b = tokens(source), tokens(candidate)
    inserted = deleted = 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            deleted += i2 - i1
            inserted += j2 - j1
    return inserted, deleted


def hard_reason(source: str, target: str, pairs: list[dict], *, precision: float = 0.96, changed: float = 0.05, lost: float = 0.2, diacritics: float = 0.9, growth: float = 1.05, grounded: float = 0.8) -> str:
    """Why an alignment changes the text it should only cut; empty if it does not."""
    out_s, out_t = " ".join(p["source"] for p in pairs), " ".join(p["target"] for p in pairs)
    for side, was, now in (("source", source, out_s), ("target", target, out_t)):
        if now.lower().count("<gap>") < was.lower().count("<gap>"):
            return f"gap_filled_{side}"
    if _NUMERIC_GAP.search(source) and "<gap>" not in out_t.lower():
        return "numeric_gap_lost"
    before, after = Counter(_NUMBER.findall(target)), Counter(_NUMBER.findall(out_t))
    if before and set(after) - set(before):
        return "number_added"
    if before and (before - after).total() > max(1, int(before.total() * lost)):
        return "numbers_lost"
    if overlap(target, out_t)[1] < precision:
        return "words_added"
    inserted, deleted = edit_counts(target, out_t)
    room = max(1, int(max(len(tokens(target)), 1) * changed))
    if inserted > room:
        return "words_inserted"
    if deleted > room:
        return "words_deleted"
    if (a := marks(source)) and (b := marks(out_s)) and difflib.SequenceMatcher(None, a, b).ratio() < diacritics:
        return "diacritics_changed"
    if source.split() and len(out_s.split()) > len(source.split()) * growth + 2:
        return "source_grew"
    known = set(tokens(source))
    for p in pairs:
        own = set(tokens(p["source"]))
        if len(p["source"]) >= 10 and own and len(own & known) / len(own) < grounded:
            return "pair_not_in_source"
    return ""


def boundary_reason(pairs: list[dict]) -> str:
    """Why the cuts are in the wrong places; empty if they are not."""
    targets = [" ".join(p["target"].split()) for p in pairs]
    for text, after in zip(targets, [*targets[1:], None], strict=True):
        if not text:
            return "empty_target"
        if ESCAPE.search(text):
            return "escape_artifact"
        if after is None:
            break
        own, following = LETTERS.findall(text), LETTERS.findall(after)
        if own and own[-1].lower() in HANGING:
            return "hanging_boundary"
        if following and following[0].lower() in MIDDLE and not TERMINAL.search(text):
            return "mid_sentence_split"
    return ""


def soft_reason(source: str, target: str, pairs: list[dict], *, low: float = 0.8, high: float = 1.1, copies: float = 0.25, short: float = 0.34) -> str:
    size = sum(len(p["target"].split()) for p in pairs) / max(len(target.split()), 1)
    if not low <= size <= high:
        return "length_changed"
    keys = [(" ".join(tokens(p["source"])), " ".join(tokens(p["target"]))) for p in pairs]
    if len(keys) > 1 and 1 - len(set(keys)) / len(keys) > copies:
        return "duplicate_pairs"
    if len(pairs) > 2 and sum(len(p["target"].split()) < 2 for p in pairs) / len(pairs) > short:
        return "short_pairs"
    return ""


def parse_payload(text: str) -> tuple[list[dict], str]:
    """(pairs, status) of a model's answer: fences and what stands around the JSON are ignored, keys have aliases."""
    t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    if not t.strip():
        return [], "empty"
    for a, b in (("{", "}"), ("[", "]")):
        i, j = t.find(a), t.rfind(b)
        if 0 <= i < j:
            try:
                blob = json.loads(re.sub(r",\s*([}\]])", r"\1", t[i : j + 1]))
            except json.JSONDecodeError:
                continue
            items = blob if isinstance(blob, list) else next((blob[k] for k in ("sentence_pairs", "pairs", "sentences") if isinstance(blob.get(k), list)), [])
            if isinstance(blob, dict) and str(blob.get("decision", "")).lower() == "reject":
                return [], "rejected"
            pairs = [{"source": str(x.get("transliteration", x.get("source", "")) or ""), "target": str(x.get("translation", x.get("target", "")) or "")} for x in items if isinstance(x, dict)]
            return pairs, "ok" if pairs else "empty_array"
    return [], "invalid"


def validate(source: str, target: str, answer: str) -> tuple[bool, str, list[dict]]:
    pairs, status = parse_payload(answer)
    if status != "ok":
        return False, status, []
    reason = hard_reason(source, target, pairs) or boundary_reason(pairs) or soft_reason(source, target, pairs)
    return not reason, reason, pairs


def validated(df: DataFrame, source: str, target: str, answer: str) -> DataFrame:
    """Adds keep, reason and pairs for recorded model answers; no model is called."""

    @F.pandas_udf("struct<keep:boolean,reason:string,pairs:array<struct<source:string,target:string>>>")
    def run(s: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([validate(x or "", y or "", z or "") for x, y, z in zip(s, t, a, strict=True)], columns=["keep", "reason", "pairs"])

    return df.withColumn("__v", run(source, target, answer)).select(*df.columns, "__v.*")


def keep_records(df: DataFrame, key: str) -> DataFrame:
    """One row for each pair of the alignments kept: key, index, source_text, target_text."""
    return df.where("keep").select(key, F.posexplode("pairs").alias("index", "p")).select(key, "index", F.col("p.source").alias("source_text"), F.col("p.target").alias("target_text"))


def english_in_source(text: Column, stop: tuple[str, ...] = tuple(ENGLISH)) -> Column:
    """Whether an English word of three letters or more stands in a source; hyphens are left out first."""
    found = F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit("")), F.lit("([a-z]{3,})"), 1)
    return F.arrays_overlap(found, F.array(*map(F.lit, stop)))


def best_window(part: str, source: list[str], start: int = 0) -> tuple[int, int]:
    """The [start, stop) of the source's words most like a part, from `start` on: the place of its best match by shared words in order."""
    want = part.split()
    if not want or start >= len(source):
        return start, start
    m = difflib.SequenceMatcher(None, source[start:], want, autojunk=False)
    blocks = [b for b in m.get_matching_blocks() if b.size]
    if not blocks:
        return start, min(start + len(want), len(source))
    first, last = blocks[0], blocks[-1]
    lo = max(0, first.a - first.b)
    hi = last.a + last.size + len(want) - last.b - last.size
    return start + lo, min(start + hi, len(source))


def resliced(pairs: list[dict], source: str) -> list[dict]:
    """Pairs whose source side is cut from the source itself, one after the other, so that nothing in it is made up."""
    ws, at, out = source.split(), 0, []
    for i, p in enumerate(pairs):
        lo, hi = best_window(p["source"], ws, at)
        if i == len(pairs) - 1:
            hi = len(ws)
        out.append({"source": " ".join(ws[at if i else 0 : hi]), "target": p["target"]})
        at = max(hi, lo)
    return out


#: Thirds spelt as decimals, and words with a digit below the line.
ODD_DECIMAL = r"(\b\d*\.(?:3333\d*|6666\d*)\b)"
ODD_WORD = r"(\S*[₀₁₂₃₄₅₆₇₈₉]\S*)"


def suspicious_forms(text: Column) -> Column:
    """struct<decimals,subscripts>: the distinct odd forms of a text, in alphabetical order."""
    t = F.coalesce(text, F.lit(""))

    def found(pattern: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?U){pattern}"), 1)))

    return F.struct(found(ODD_DECIMAL).alias("decimals"), found(ODD_WORD).alias("subscripts"))


def suspicious_pairs(df: DataFrame, key: str, pairs: str) -> DataFrame:
    """(key, sentence, source_forms, target_forms, source, target) of the sentences of an array of pairs that have an odd form, numbered from 1."""
    d = df.select(key, F.posexplode(pairs).alias("place", "p"))
    d = d.select(key, (F.col("place") + 1).alias("sentence"), suspicious_forms(F.col("p.source")).alias("source_forms"), suspicious_forms(F.col("p.target")).alias("target_forms"), F.col("p.source").alias("source"), F.col("p.target").alias("target"))
    return d.where(" OR ".join(f"size({side}_forms.{kind}) > 0" for side in ("source", "target") for kind in ("decimals", "subscripts")))


def word_tokens(text: Column) -> Column:
    """How many runs of letters and digits, with the marks that join them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\w]+"))


def number_list(text: Column) -> Column:
    """The numbers of a text in their order, fractions after them included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[./]\d+)?[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞]?|[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞])"), 1)


def debug_event(df: DataFrame, key: str, answer: str, source: str, target: str, retries: str | None = None, most: int = 8000) -> DataFrame:
    """(key, event): what is known of an alignment as JSON: its texts and answer, cut with a note, the verdict, and its odd forms."""
    from quern.functions.records import cut_with_note

    forms = F.struct(suspicious_forms(F.col(source)).alias("source"), suspicious_forms(F.col(target)).alias("target"))
    status = F.when(F.col("keep"), "aligned").otherwise("rejected")
    event = F.struct(
        F.col(key).alias("id"), status.alias("status"), F.col("reason"), (F.col(retries) if retries else F.lit(0)).alias("retries"), F.size("pairs").alias("sentences"),
        cut_with_note(F.col(source), most).alias("source"), cut_with_note(F.col(target), most).alias("target"), cut_with_note(F.col(answer), most).alias("answer"), forms.alias("forms"),
    )
    return df.select(key, F.to_json(event).alias("event"))


def reject_records(df: DataFrame, key: str) -> DataFrame:
    """One row for each alignment that was not kept: key, reason, and the proposed pairs as JSON."""
    return df.where(~F.col("keep")).select(key, "reason", F.to_json("pairs").alias("proposed"))


def mark_signature(text: Column) -> Column:
    """The letters of a text beyond ASCII, in order: they tell silent edits."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x7F]|[^\p{L}]", "")
