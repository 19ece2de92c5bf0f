"""Seeded augmentation: each row's randomness comes from its own key, so that order and partitions do not matter."""

from __future__ import annotations

import hashlib
import math
import random
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let, words

GAP = "<gap>"
#: The id of byte 0 in a byte vocabulary.
FIRST = 3
#: Letters and spellings that recognition confuses.
CONFUSED = {"ṭ": "m", "ṣ": "s", "š": "s", "ḫ": "h", "ú": "u", "ù": "u", "í": "i", "ì": "i", "á": "a", "à": "a", "é": "e", "è": "e", "₄": "4"}
CONFUSED_WORDS = {"ṭup-pì": "mup-pì", "ṭup-pu": "mup-pu", "KÙ.BABBAR": "KÙ.B.", "šu-ma": "su-ma", "a-na": "ana"}


def row_rng(seed: int, key: object) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big"))


def damage(text: str, rng: random.Random, chance: float = 0.1, span_share: float = 0.7) -> str:
    """With a chance, one word or a run of 2 to 5 words becomes a gap, never next to a gap that is there."""
    ws = text.split()
    if len(ws) < 3 or rng.random() > chance:
        return text
    free = [i for i, w in enumerate(ws) if "<" not in "".join(ws[max(0, i - 1) : i + 2])]
    if not free:
        return text
    if rng.random() < span_share:
        pairs = [i for i in free if i + 1 in set(free)]
        if not pairs:
            return text
        at, n = pairs[0], 1
        want = rng.randint(2, 5)
        while n < want and at + n in set(free):
            n += 1
        ws[at : at + n] = [GAP]
    else:
        ws[rng.choice(free)] = GAP
    return " ".join(ws)


@dataclass(frozen=True)
class Noise:
    """How likely each misreading is: a spelling, a letter, a lost hyphen, a broken word; and of a text, a gap added or in a word's place."""

    spelling: float = 0.4
    letter: float = 0.14
    hyphen: float = 0.75
    broken: float = 0.25
    gap_added: float = 0.3
    gap_instead: float = 0.18
    #: Of the words, the share that is tried and the greatest share that is changed.
    tried: float = 1.0
    changed: float = 1.0


#: The noise of correction examples, and the lighter one of training texts.
STRONG, LIGHT = Noise(), Noise(0.35, 0.12, 0.60, 0.18, 0.10, 0.06, 0.32, 0.35)


def misread(word: str, rng: random.Random, noise: Noise = STRONG) -> str:
    """One word as recognition may read it; gaps and tags stay."""
    if not word or word == GAP or "[[" in word or "]]" in word:
        return word
    out = word
    for clean, noisy in CONFUSED_WORDS.items():
        if clean in out and rng.random() < noise.spelling:
            out = out.replace(clean, noisy)
    out = "".join(CONFUSED.get(c, c) if rng.random() < noise.letter else c for c in out)
    syllables = [x for x in out.split("-") if x]
    if "-" in out and rng.random() < noise.hyphen and len(syllables) > 1:
        out = rng.choice((" ", "")).join(syllables)
    if out == word and len(word) >= 4 and not set("<{}") & set(word) and rng.random() < noise.broken:
        at = rng.randrange(1, len(out) - 1)
        out = f"{out[:at]} {out[at:]}"
    return out


def ocr_noise(text: str, rng: random.Random, noise: Noise = STRONG, chance: float = 1.0) -> str:
    """A text as recognition may read it: misread words and a gap. What chance leaves alone loses a hyphen or has one letter misread.

    `chance` is that of any noise at all; texts of one word stay under a light noise.
    """
    ws = text.split()
    able = [i for i, w in enumerate(ws) if w != GAP and "[[" not in w and "]]" not in w]
    if not able or chance < 1 and (len(ws) < 2 or rng.random() > chance):
        return text
    was, room = list(ws), max(1, math.ceil(len(able) * noise.changed))
    for i in able:
        if room and rng.random() < noise.tried:
            ws[i] = misread(ws[i], rng, noise)
            room -= ws[i] != was[i]
    if len(ws) >= 3 and rng.random() < noise.gap_added:
        ws.insert(rng.randrange(1, len(ws)), GAP)
    elif len(ws) >= 2 and rng.random() < noise.gap_instead:
        ws[rng.choice([i for i, w in enumerate(ws) if "<" not in w] or [0])] = GAP
    if ws == was:
        i = next((i for i in able if "-" in ws[i]), None)
        if i is not None:
            ws[i] = ws[i].replace("-", " ", 1)
        else:
            i, c = next(((i, c) for i in able for c in ws[i] if c in CONFUSED), (None, ""))
            if i is not None:
                ws[i] = ws[i].replace(c, CONFUSED[c], 1)
    return re.sub(rf"{GAP}(?: {GAP})+", GAP, " ".join(ws))


def augmented(df: DataFrame, key: str, text: str, kind: str, seed: int = 42, name: str = "augmented", **options) -> DataFrame:
    """Adds a damaged or noisy version of a text; `kind` is damage, ocr_noise or light_noise."""
    fn = {"damage": damage, "ocr_noise": ocr_noise, "light_noise": partial(ocr_noise, noise=LIGHT, chance=0.5)}[kind]

    @F.pandas_udf("string")
    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([fn(t or "", row_rng(seed, k), **options) for k, t in zip(keys, texts, strict=True)])

    return df.withColumn(name, run(F.col(key).cast("string"), F.col(text)))


def segments(n: int, k: int, rng: np.random.Generator) -> list[int]:
    """n items in k parts of at least one, all such divisions equally likely."""
    cuts = np.sort(rng.choice(n - 1, k - 1, replace=False)) + 1 if k > 1 else np.array([], int)
    return np.diff(np.concatenate(([0], cuts, [n]))).astype(int).tolist()


def span_mask(n: int, density: float, mean: float, rng: np.random.Generator) -> np.ndarray:
    """Which of n places are masked: spans of the mean length that make up the density, kept ones before each."""
    if n < 2:
        return np.ones(n, bool)
    noisy = min(max(int(np.round(n * density)), 1), n - 1)
    spans = min(max(int(np.round(noisy / mean)), 1), noisy, n - noisy)
    out = []
    for keep, hide in zip(segments(n - noisy, spans, rng), segments(noisy, spans, rng), strict=True):
        out += [False] * keep + [True] * hide
    return np.array(out)


def byte_ids(text: str, most: int = 512) -> list[int]:
    """UTF-8 bytes plus 3, with the end id 1, cut to `most`."""
    return [b + 3 for b in text.encode()[: most - 1]] + [1]


def byte_text(ids: list[int]) -> str:
    """The text of byte ids; what is no byte, and broken characters, are left out."""
    return bytes(i - 3 for i in ids if 3 <= i < 259).decode("utf-8", "ignore")


def corrupted(ids: list[int], seed: int, density: float = 0.15, mean: float = 20.0, first_sentinel: int = 258, end: int = 1) -> tuple[list[int], list[int]]:
    """(input, labels): masked spans become sentinels in the input and follow theirs in the labels."""
    ids = ids if len(ids) > 1 else (ids or [end]) * 2
    mask = span_mask(len(ids), density, mean, np.random.default_rng(seed))
    source, target, sentinel = [], [], first_sentinel
    for i, (t, m) in enumerate(zip(ids, mask, strict=True)):
        if not m:
            source.append(t)
            continue
        if i == 0 or not mask[i - 1]:
            source.append(sentinel)
            target.append(sentinel)
            sentinel -= 1
        target.append(t)
    return [*source, end], [*target, end]


def denoising_set(df: DataFrame, key: str, text: str, variants: int = 4, seed: int = 42, density: float = 0.15, mean: float = 20.0) -> DataFrame:
    """(key, variant, input_ids, labels): span-corrupted variants of each whole text's bytes; texts that are to fit a length are cut into chunks before."""

    @F.pandas_udf("struct<input_ids:array<int>,labels:array<int>>")
    def run(keys: pd.Series, n: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for k, v, t in zip(keys, n, texts, strict=True):
            own = int.from_bytes(hashlib.blake2b(f"{seed}|{k}|{v}".encode(), digest_size=8).digest(), "big")
            rows.append(corrupted([b + FIRST for b in (t or "").encode()], own, density, mean))
        return pd.DataFrame(rows, columns=["input_ids", "labels"])

    d = df.select(key, text, F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    return d.select(key, "variant", run(F.col(key).cast("string"), "variant", text).alias("x")).select(key, "variant", "x.*")


#: Glosses of function words, which a model learns by itself.
PLAIN_GLOSSES = (
    "to, for", "and, but, also", "and", "but", "also", "or", "who(m), which; (s)he who, that which; of", "not, no; without, un-", "not", "no", "like; when, as, that", "saying:", "if",
    "from, out of; since, after", "with", "may, let", "until, as far as", "you", "I; me", "we", "this", "that", ", on; by; from", "there", "here", "as much as", "because (of)",
    "not, no", "before, in front of",
)


def glossed(text: Column, lexicon: Column, form: str = "[{eng}]") -> Column:
    """A text with each known word's gloss after it, those of function words left out; null if it has none."""
    gloss = lambda w: F.element_at(lexicon, F.lower(w))
    known = lambda w: gloss(w).isNotNull() & (gloss(w) != "") & ~gloss(w).isin(*PLAIN_GLOSSES)
    before, after = form.split("{eng}")
    some = lambda ws: F.when(F.exists(ws, known), F.array_join(F.transform(ws, lambda w: F.when(known(w), F.concat(w, F.lit(" " + before), gloss(w), F.lit(after))).otherwise(w)), " "))
    return let(words(text), some)


def task_share(train: DataFrame, added: DataFrame, key: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """The training rows, and of the added task's as many as make `share` of the whole, drawn by a hash; all of them where there are fewer."""
    from quern.operators.splits import first_drawn

    most = int(train.count() * share / (1 - share))
    return train.unionByName(first_drawn(added, key, most, seed) if added.count() > most else added, allowMissingColumns=True)


def correction_examples(df: DataFrame, key: str, text: str, prompt: str, seed: int = 42) -> DataFrame:
    """(key, task, system_prompt, input_text, target_text): noisy texts to be corrected."""
    d = augmented(df.select(key, text), key, text, "ocr_noise", seed, "noisy")
    return d.select(key, F.lit("ocr_correction").alias("task"), F.lit(prompt).alias("system_prompt"), F.concat(F.lit("Input (Noisy):\n"), "noisy").alias("input_text"), F.col(text).alias("target_text"))


def training_inputs(df: DataFrame, key: str, source: str, epoch: int = 0, seed: int = 42, damage_chance: float = 0.1, noise_chance: float = 0.15, hints: Column | None = None, examples: Column | None = None, context: Column | None = None, prefix: Column | None = None) -> DataFrame:
    """Adds `input_text`: the source as one epoch of training shows it.

    Damage, then noise, each drawn by the row's key and the epoch; then, where
    they are given, hints after it, the row before it as context, examples and
    the prefix before it. No row depends on another's place.
    """

    @F.pandas_udf("string")
    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for k, t in zip(keys, texts, strict=True):
            rng = row_rng(seed + epoch, k)
            out.append(ocr_noise(damage(t or "", rng, damage_chance), rng, LIGHT, noise_chance))
        return pd.Series(out)

    parts = [run(F.col(key).cast("string"), F.col(source))]
    if hints is not None:
        parts.append(F.when(F.size(hints) > 0, F.concat(F.lit(" ## HINTS: "), F.array_join(hints, "; "))).otherwise(""))
    if context is not None:
        parts.insert(0, F.when(context != "", F.concat(context, F.lit(" || "))).otherwise(""))
    if prefix is not None:
        parts.insert(0, prefix)
    if examples is not None:
        parts.insert(0, F.when(F.size(examples) > 0, F.concat(F.lit("Examples:\n"), F.array_join(examples, "\n"), F.lit("\n"))).otherwise(""))
    return df.withColumn("input_text", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))
