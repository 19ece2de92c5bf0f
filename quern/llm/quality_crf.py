"""Line quality by a linear-chain conditional random field, and document quality from it.

Each line with a word is a node with features of its own and of its
neighbours; a label is good or bad. Training maximises the conditional
likelihood of the lines' labels (a line has its document's) over a bounded
sample of labelled documents; forward-backward gives each line's marginal of
good, and the length-weighted mean of the marginals is the document's score.

Bounds: at most `max_docs` labelled documents are learned from, chosen by a
hash of the id, and of each at most its first `max_chars` characters. Scoring
reads whole texts; a batch is cut into parts of at most `PART_DOCS` documents,
`PART_CHARS` characters and `PART_LINES` lines, but for one text that is longer
by itself, so memory follows the longest text.

Defined results: a text without a word has the score `empty_score`; without
labelled documents every score is 0.5; ties and repeated rows score alike;
documents labelled more than once count by their mean label, rounded up.
Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.quality_rules import STOP_WORDS

PART_DOCS, PART_CHARS, PART_LINES = 512, 1 << 22, 1 << 15
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_LINE = re.compile(rb"[^\n]+")
#: Byte classes that are counted in a line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "stop": b".,;:",
    "shout": b"!?",
    "bracket": b"()[]{}=\"'/\\@_~^+",
}
OWN = (*CLASSES, "wide", "word_length", "log_words", "distinct", "stop_words", "seen_before", "lone_symbols", "ends")
#: The line's own features, and those of the line before and after (0 beyond the text), with flags for the ends.
N_FEATURES = 3 * len(OWN) + 2
_LUT = np.zeros((256, len(CLASSES) + 1), np.float32)
for _k, _v in enumerate(CLASSES.values()):
    _LUT[list(_v), _k] = 1
_LUT[128:192, len(CLASSES)] = 1  # continuation bytes: letters beyond ASCII


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the lines' lengths in bytes, of lines with a word."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    rows, sizes, spans = [], [], []
    seen: set[bytes] = set()
    for m in _LINE.finditer(raw):
        line = m[0]
        words = line.split()
        if not words:
            continue
        low = line.lower().split()
        n = len(words)
        chars = sum(map(len, words))
        rows.append((
            min(chars / n, 20.0) / 5,
            np.log1p(n),
            len(set(low)) / n,
            sum(map(_STOP.__contains__, low)) / n,
            float(line in seen),
            sum(len(w) == 1 and not w.isalnum() for w in set(words)) and sum(w in b"|#*$%&<>-=~" for w in words) / n,
            float(words[-1][-1] in b".!?\"')"),
        ))
        seen.add(line)
        sizes.append(len(line))
        spans.append(m.span())
    if not rows:
        return np.empty((0, len(OWN)), np.float32), np.empty(0)
    b = np.frombuffer(raw, np.uint8)
    at = np.array(spans).ravel()
    counts = np.empty((len(rows), _LUT.shape[1]), np.float32)
    for k in range(_LUT.shape[1]):
        total = np.concatenate(([0], np.cumsum(_LUT[:, k][b], dtype=np.float64)))
        counts[:, k] = total[at[1::2]] - total[at[::2]]
    size = np.array(sizes, np.float64)
    return np.hstack([counts / size[:, None], np.array(rows)]).astype(np.float32), size


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """The features of lines in context; the text's first and last line are told."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.zeros((n, 2), x.dtype)
    if n:
        ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([x, before, after, ends])


@dataclass(frozen=True)
class Crf:
    """Weights of good against bad for each feature, and the transition scores [from, to], 0 bad and 1 good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    empty_score: float

    def emissions(self, x: np.ndarray) -> np.ndarray:
        w = self.weights / self.scale
        out = np.empty(len(x))
        for at in range(0, len(x), PART_LINES):  # whole lines at once, but few
            out[at : at + PART_LINES] = x[at : at + PART_LINES] @ w
        return out + (self.bias - self.mean @ w)


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sequences by length, their starts, and how many are longer than each step."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    return order, starts, active


def forward_backward(e: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, the log partition of each sequence, and the summed pair marginals [from, to].

    e holds the emission scores of good of all lines, sequence after sequence
    (none empty). All sequences take each step together, the longest first.
    """
    order, starts, active = _lanes(sizes)
    steps = len(active)
    alpha, beta = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    at = starts
    alpha[at, 1] = e[at]
    for t in range(1, steps):
        at = starts[: active[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(a[:, 0] + transition[0, 0], a[:, 1] + transition[1, 0])
        alpha[at, 1] = np.logaddexp(a[:, 0] + transition[0, 1], a[:, 1] + transition[1, 1]) + e[at]
    for t in range(steps - 1, 0, -1):
        at = starts[: active[t]] + t
        b0, b1 = beta[at, 0], beta[at, 1] + e[at]
        beta[at - 1, 0] = np.logaddexp(b0 + transition[0, 0], b1 + transition[0, 1])
        beta[at - 1, 1] = np.logaddexp(b0 + transition[1, 0], b1 + transition[1, 1])
    ends = starts + sizes[order] - 1
    logz = np.empty(len(sizes))
    logz[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.repeat(logz, sizes)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0))
    inner = np.ones(len(e), bool)
    inner[np.cumsum(sizes) - sizes] = False
    to = np.flatnonzero(inner)
    pairs = np.zeros((len(to), 4))
    for i in (0, 1):
        for j in (0, 1):
            pairs[:, 2 * i + j] = np.exp(alpha[to - 1, i] + transition[i, j] + (e[to] if j else 0) + beta[to, j] - z[to])
    return good, logz, pairs


def fit(x: list[np.ndarray], labels: list[int], rounds: int = 300, rate: float = 0.05, ridge: float = 1e-3, seed_bias: float = 0.0) -> Crf:
    """Adam on the mean negative log-likelihood per line-normalised document; deterministic."""
    some = [(a, y) for a, y in zip(x, labels, strict=True) if len(a)]
    empties = [y for a, y in zip(x, labels, strict=True) if not len(a)]
    empty_score = (sum(empties) + 0.1) / (len(empties) + 1)
    if not some:
        return Crf(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, np.zeros((2, 2)), 0.5)
    sizes = np.array([len(a) for a, _ in some])
    flat = np.vstack([a for a, _ in some]).astype(np.float64)
    mean, scale = flat.mean(0), flat.std(0) + 1e-3
    flat = (flat - mean) / scale
    y = np.repeat(np.array([y for _, y in some], np.float64), sizes)
    weight = np.repeat(1.0 / sizes, sizes) / len(some)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - sizes] = False
    kind = (3 * y).astype(int)  # a document's lines are all good or all bad
    p = np.zeros(N_FEATURES + 5)
    p[N_FEATURES] = seed_bias
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        tr = p[N_FEATURES + 1 :].reshape(2, 2)
        good, _, pairs = forward_backward(flat @ p[:N_FEATURES] + p[N_FEATURES], sizes, tr)
        miss = (good - y) * weight
        grad = np.zeros_like(p)
        grad[:N_FEATURES] = miss @ flat + ridge * p[:N_FEATURES]
        grad[N_FEATURES] = miss.sum()
        seen = np.zeros_like(pairs)
        seen[np.arange(len(pairs)), kind[inner]] = 1
        grad[N_FEATURES + 1 :] = ((pairs - seen) * weight[inner][:, None]).sum(0) + ridge * p[N_FEATURES + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf(mean, scale, p[:N_FEATURES], float(p[N_FEATURES]), p[N_FEATURES + 1 :].reshape(2, 2).copy(), empty_score)


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 3000, max_chars: int = 20_000) -> Crf:
    """Fits on at most `max_docs` labelled rows for which `train` (over the id `doc_id`) holds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(train)
    known = known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    n = known.count()
    h = F.xxhash64(F.col("doc_id").cast("string"))
    share = min(1.0, 2 * max_docs / max(n, 1))
    rows = known.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(h, "doc_id").limit(max_docs).collect()
    y = {r["doc_id"]: r["y"] for r in rows}
    if not y:
        return fit([], [])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.col("doc_id").isin(list(y))).withColumn("text", F.left("text", F.lit(max_chars)))
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))  # repeated rows count once
    got = sorted((r["doc_id"], r["text"]) for r in texts.collect())  # at most max_docs texts of max_chars
    return fit([with_neighbours(line_features(t)[0]) for _, t in got], [y[i] for i, _ in got])


def scores(crf: Crf, texts: list[str | None]) -> np.ndarray:
    parts = [line_features(t) for t in texts]
    sizes = np.array([len(s) for _, s in parts])
    out = np.full(len(texts), crf.empty_score)
    some = np.flatnonzero(sizes)
    if len(some):
        x = np.vstack([with_neighbours(parts[i][0]) for i in some])
        good, _, _ = forward_backward(crf.emissions(x), sizes[some], crf.transition)
        w = np.concatenate([parts[i][1] for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts)
    return np.clip(out, 0.0, 1.0)


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of the parts of a batch."""
    start, size, lines = 0, 0, 0
    chars, breaks = (pc.fill_null(x, 0).to_pylist() for x in (pc.utf8_length(texts), pc.count_substring(texts, "\n")))
    for i, (n, k) in enumerate(zip(chars, breaks, strict=True)):
        if i > start and (i - start >= PART_DOCS or size + n > PART_CHARS or lines + k >= PART_LINES):
            yield start, i - start
            start, size, lines = i, 0, 0
        size, lines = size + n, lines + k + 1
    if start < len(texts):
        yield start, len(texts) - start


def line_marginals(crf: Crf, text: str | None) -> list[float]:
    """Each line's probability of good, for inspection."""
    x, size = line_features(text)
    return forward_backward(crf.emissions(with_neighbours(x)), np.array([len(size)]), crf.transition)[0].tolist() if len(size) else []


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: good likelier)."""
    from quern.llm.common import map_arrow, narrow

    d = narrow(docs, id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(crf)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in parts_of(batch.column(1)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(shared.value, part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
