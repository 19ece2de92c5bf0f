"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled
text. A whole text is parsed greedily into phrases, each the longest match
that the automaton holds; the language whose parse has the fewest phrases,
normalised by log2 of its sample's length over the text's (the cross-parsing
entropy), wins.

All automata share one hash table of transitions with two places for each,
so memory follows the samples' length, not the alphabet's. A text is cut into
blocks of `BLOCK` letters that are parsed side by side, each from the root;
then each block is entered again in the state in which the block before ended,
until that parse and the block's own are in one state: from there on they are
the same. The counts are those of the one parse of the whole text, and the
cost is linear in it.

Bounds: at most `max_rows` rows and `max_chars` characters of a language are
learned from, of a row at most its first `row_chars`; the rows of the least
hashes are taken, in one pass over the table for all languages.

Defined results: `und` and score 0 for a null text or one without a letter;
ties go to the first language in sorted order; without any labelled text all
are `und`. Repeated rows get equal answers, and count once in a sample. Extra
columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
UNKNOWN = "und"
#: Symbol 0 is a run of anything but letters, 1 a letter in no sample.
GAP, OTHER = 0, 1


def sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, train: Column, max_rows: int = 64, max_chars: int = 40_000, row_chars: int | None = None) -> dict[str, str]:
    """Language -> text of a bounded sample of its training rows; a row gives at most its first `row_chars` characters (a quarter of `max_chars`)."""
    row_chars = row_chars or max(1, max_chars // 4)
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("train"))
    d = d.where("train AND lang IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    # each task cuts its rows to the first of a language before the exchange; only hashes travel
    w = Window.partitionBy("lang").orderBy("h")
    first = d.select("lang", "h").withColumn("i", F.dense_rank().over(w)).where(F.col("i") <= max_rows).groupBy("lang").agg(F.max("h").alias("last"))
    last = {r["lang"]: r["last"] for r in first.collect()}  # one number a language
    if not last:
        return {}
    bound = F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair])[F.col("lang")]
    rows = d.where(F.col("h") <= bound).select("lang", "h", F.left("text", F.lit(row_chars)).alias("text")).distinct()
    texts: dict[str, list[str]] = {}
    left = dict.fromkeys(last, max_chars)
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):  # at most max_rows a language
        if part := r["text"][: left[r["lang"]]]:
            texts.setdefault(r["lang"], []).append(part)
            left[r["lang"]] -= len(part)
    return {lang: "\n".join(t) for lang, t in texts.items()}


class Alphabet:
    """Maps code points to symbols; letters of the samples from 2 on, lower-cased."""

    def __init__(self, texts: list[str]) -> None:
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha() and ord(c) < 65536})
        at = {c: i + 2 for i, c in enumerate(letters)}
        self.size = len(letters) + 2
        self.lut = np.zeros(65536, np.uint16)
        for cp in range(65536):
            c = chr(cp)
            if c.isalpha():
                self.lut[cp] = at.get(c.lower(), OTHER)

    def symbols(self, text: str) -> np.ndarray:
        """The symbols, runs of gaps as one."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        s = self.lut[np.minimum(cp, 65535)]
        wide = np.flatnonzero(cp > 65535)
        if len(wide):
            s = s.copy()
            s[wide] = [OTHER if chr(c).isalpha() else GAP for c in cp[wide].tolist()]
        keep = s != GAP
        keep[1:] |= s[:-1] != GAP
        return s[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Places:
    """A map of distinct whole numbers to whole numbers in which each key is at one of two places."""

    _ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.views: tuple | None = None
        bits = max(4, math.ceil(math.log2(2.4 * len(keys) + 1)))
        while not self._dealt(keys.astype(np.uint64), values, bits):
            bits += 1

    def _dealt(self, keys: np.ndarray, values: np.ndarray, bits: int) -> bool:
        """Each key takes its place; those that lost theirs to another take their other one, until none has."""
        self.shift = np.uint64(64 - bits)
        for a, b in (self._ODD[:2], self._ODD[2:]):
            self.odd = (np.uint64(a), np.uint64(b))
            places = np.stack([(keys * m) >> self.shift for m in self.odd]).astype(np.int64)
            which, every = np.zeros(len(keys), np.int64), np.arange(len(keys))
            owner = np.full(1 << bits, -1, np.int64)
            todo = every
            for _ in range(500):
                owner[places[which[todo], todo]] = todo
                todo = np.flatnonzero(owner[places[which, every]] != every)
                if not len(todo):
                    some = owner >= 0
                    self.keys, self.values = np.full(1 << bits, 1 << 63, np.uint64), np.zeros(1 << bits, np.int32)
                    self.keys[some], self.values[some] = keys[owner[some]], values[owner[some]]
                    return True
                which[todo] ^= 1
        return False

    def one(self, key: int) -> int | None:
        """The value of one key; None if it is missing."""
        if self.views is None:
            self.views = memoryview(self.keys), memoryview(self.values), tuple(map(int, self.odd)), int(self.shift)
        keys, values, odd, shift = self.views
        for m in odd:
            at = (key * m & 0xFFFFFFFFFFFFFFFF) >> shift
            if keys[at] == key:
                return values[at]
        return None

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of keys, any of which may be missing."""
        at = (keys * self.odd[0]) >> self.shift
        found = self.keys.take(at) == keys
        out = self.values.take(at)
        rest = np.flatnonzero(~found)
        other = (keys[rest] * self.odd[1]) >> self.shift
        found[rest] = self.keys.take(other) == keys[rest]
        out[rest] = self.values.take(other)
        return out, found


class Model:
    """The languages' automata: states of all, transitions in one table, and where a phrase that begins with a symbol leads."""

    def __init__(self, texts: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in texts]
        self.alphabet = Alphabet([t for _, t in texts])
        a = self.alphabet.size
        keys, values, first, weights, roots = [], [], [], [], []
        base = 0
        for _, text in texts:
            s = self.alphabet.symbols(text).tolist()
            step = suffix_automaton(s)
            keys.append(np.array([(base + i) * a + c for i, d in enumerate(step) for c in d], np.int64))
            values.append(np.array([base + j for d in step for j in d.values()], np.int64))
            first.append([base + step[0].get(c, 0) for c in range(a)])
            weights.append(math.log2(len(s) + 2))
            roots.append(base)
            base += len(step)
        self.weights, self.roots, self.first = np.array(weights), np.array(roots, np.int32), np.array(first, np.int32).reshape(-1, a)
        if texts:
            self.table = Places(np.concatenate(keys), np.concatenate(values))

    def _step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and whether the phrase ended before it."""
        new, found = self.table.get(state.astype(np.uint64) * np.uint64(self.alphabet.size) + symbol)
        ended = ~found
        at = np.flatnonzero(ended)
        new[at] = self.first[lang[at], symbol[at]]
        return new, ended

    def phrases(self, lanes: list[np.ndarray], follows: np.ndarray, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(languages, lanes) phrases that begin in lanes of at most BLOCK symbols, and the last lane's states at its end.

        A lane with `follows` goes on with the parse of the one before; the
        first such lane with that of the states `entry`.
        """
        n, total = len(self.langs), len(lanes)
        sizes = np.array([len(x) for x in lanes])
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        m = np.zeros((total, BLOCK), np.uint64)
        m[np.repeat(place, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(lanes)
        m = np.ascontiguousarray(m.T)
        active = np.searchsorted(-sizes[order], -np.arange(BLOCK), side="left")  # lanes longer than each place
        lang = np.repeat(np.arange(n), total).reshape(n, total)
        state = np.repeat(self.roots[:, None], total, axis=1)
        count = np.ones((n, total), np.int64)
        for t in range(BLOCK):
            k = int(active[t])
            if not k:
                break
            new, ended = self._step(state[:, :k].ravel(), lang[:, :k].ravel(), np.tile(m[t, :k], n))
            state[:, :k] = new.reshape(n, k)
            count[:, :k] += ended.reshape(n, k)
        end, own = state[:, place], count[:, place]
        before = np.roll(end, 1, axis=1)
        if entry is not None:
            before[:, 0] = entry
        # enter each lane as the one before ends by itself, all side by side
        total_count, true_end = own.copy(), end.copy()
        j, i = (x.ravel() for x in np.broadcast_arrays(np.arange(n)[:, None], np.flatnonzero(follows)[None, :]))
        a, b = before[j, i], self.roots[j]
        more = np.full(len(j), -1)
        t = 0
        late: list[tuple[int, int]] = []  # lanes of a language that end otherwise than by themselves
        while len(j):
            over = t >= sizes[i]
            if over.any():
                total_count[j[over], i[over]] = own[j[over], i[over]] + more[over]
                true_end[j[over], i[over]] = a[over]
                late += zip(j[over].tolist(), i[over].tolist(), strict=True)
                j, i, a, b, more = (x[~over] for x in (j, i, a, b, more))
                if not len(j):
                    break
            c = m[t, place[i]]
            a, ended_a = self._step(a, j, c)
            b, ended_b = self._step(b, j, c)
            more = more + ended_a - ended_b
            same = a == b
            total_count[j[same], i[same]] = own[j[same], i[same]] + more[same]
            j, i, a, b, more = (x[~same] for x in (j, i, a, b, more))
            t += 1
        # where that was not its end, as in a long text that the sample holds, the next goes again, in turn
        todo = sorted(late)
        while todo:
            x, y = heapq.heappop(todo)
            state = int(true_end[x, y])
            if y + 1 >= total or not follows[y + 1] or before[x, y + 1] == state:
                continue
            before[x, y + 1] = state
            added, left = self._entered(x, lanes[y + 1].tolist(), state)
            total_count[x, y + 1] = own[x, y + 1] + added
            true_end[x, y + 1] = end[x, y + 1] if left is None else left
            heapq.heappush(todo, (x, y + 1))
        return total_count, true_end[:, -1]

    def _entered(self, lang: int, symbols: list[int], a: int) -> tuple[int, int | None]:
        """What a lane adds if it is entered in state a, and the state in which it ends; None for its own."""
        b, more = int(self.roots[lang]), -1
        first, size = self.first[lang], self.alphabet.size
        for c in symbols:
            x, y = self.table.one(a * size + c), self.table.one(b * size + c)
            a, b = int(first[c]) if x is None else x, int(first[c]) if y is None else y
            more += (x is None) - (y is None)
            if a == b:
                return more, None
        return more, a

    def counts(self, symbols: list[np.ndarray], lanes_at_once: int = 8192) -> np.ndarray:
        """(languages, texts) phrases of whole texts, none of them empty."""
        total = np.zeros((len(self.langs), len(symbols)), np.int64)
        owner: list[int] = []
        lanes: list[np.ndarray] = []
        entry = None

        def flush() -> None:
            nonlocal entry
            if lanes:
                who = np.array(owner)
                follows = np.concatenate(([entry is not None and who[0] == last], who[1:] == who[:-1]))
                got, entry = self.phrases(lanes, follows, entry)
                np.add.at(total.T, who, got.T)
                owner.clear()
                lanes.clear()

        last = -1
        for i, s in enumerate(symbols):
            for at in range(0, len(s), BLOCK):
                lanes.append(s[at : at + BLOCK])
                owner.append(i)
                if len(lanes) >= lanes_at_once:
                    flush()
                    last = i
        flush()
        return total

    def predict(self, texts: list[str | None], lanes_at_once: int = 8192) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        symbols = [self.alphabet.symbols(t) if t else np.empty(0, np.uint16) for t in texts]
        some = [i for i, s in enumerate(symbols) if s.any()]
        if not some:
            return out
        found = self.counts([symbols[i] for i in some], lanes_at_once)
        for k, i in enumerate(some):
            e = found[:, k] * self.weights / len(symbols[i])
            best = int(np.argmin(e))
            second = float(np.min(np.delete(e, best))) if len(e) > 1 else None
            out[i] = (self.langs[best], 1.0 if second is None else second / (second + float(e[best])))
        return out


@lru_cache(maxsize=2)
def model_of(texts: tuple[tuple[str, str], ...]) -> Model:
    """Built once in a worker; the samples are small, their tables are not sent."""
    return Model(texts)


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (the runner-up's share of the two best entropies, 0.5 to 1; 0 if und)."""
    from quern.llm.common import map_arrow, narrow

    d = narrow(docs, id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                got = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
