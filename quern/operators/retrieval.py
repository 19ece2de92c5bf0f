"""Lexical retrieval as relational plans: an inverted index is a table, a query is a join on its terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quern.functions.text import let, squeeze, words
from quern.operators import windows

#: Rows of a table that may be sent to every task; larger ones are joined by an exchange.
SMALL = 1_000_000
#: Character n-grams of the cosine's vocabulary.
FEATURES = 8000


def _small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has at most SMALL rows, which are counted without reading more."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def asked_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, times) of the queries' words."""
    return queries.select(F.col(query).alias("query"), F.explode(words(F.lower(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None, few: int = 20_000) -> DataFrame:
    """(doc, term, tf, size): each document's terms with their counts and its length; only those asked for, if any are given.

    A `few` terms are looked for within the row, so that no other word leaves
    it; more are joined.
    """
    d = docs.select(F.col(key).alias("doc"), words(F.lower(text)).alias("w"))
    size = F.size("w").alias("size")
    asked = [r[0] for r in terms.select("term").distinct().limit(few + 1).collect()] if terms is not None else None
    if asked is not None and len(asked) <= few:
        d = d.select("doc", size, F.explode(F.filter("w", lambda x: x.isin(asked)) if asked else F.slice("w", 1, 0)).alias("term"))
        return d.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    d = d.select("doc", size, F.explode("w").alias("term"))
    if terms is not None:
        d = d.join(terms.select(F.col("term").alias("asked")).distinct(), F.col("term") == F.col("asked"), "left_semi")
    return d.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n, df): how often each word stands in all and in how many rows; counted a batch at a time, so that few rows go through the exchange."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column("text"), " ")
            coded = split.flatten().dictionary_encode()
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            df = np.bincount(np.unique(row * size + code) % max(size, 1), minlength=size)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(code, minlength=size)), pa.array(df)], ["term", "n", "df"])

    made = docs.select(squeeze(F.lower(text)).alias("text")).mapInArrow(counted, "term string, n long, df long")
    return made.where("term != ''").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


class Index:
    """What BM25 needs of the documents for some queries: their weighed terms and the postings of those."""

    def __init__(self, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> None:
        self.k1, self.b = k1, b
        w = docs.select(words(F.lower(text)).alias("w"))
        sizes = w.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg")).first()
        self.n, self.average = sizes["n"], sizes["avg"] or 0.0
        asked = asked_terms(queries, query, query_text)
        # every word's documents count for the mean
        self.words = df = word_counts(docs, text).persist(StorageLevel.MEMORY_AND_DISK)
        idf = df.select("term", "df", (F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = idf.agg(F.avg("raw").alias("mean"))  # one row, of the same exchange
        weight = F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw"))
        terms = asked.join(idf.withColumnRenamed("term", "t"), F.col("term") == F.col("t")).crossJoin(F.broadcast(mean)).select("query", "term", "times", "df", weight.alias("idf"))
        self.terms = terms.persist(StorageLevel.MEMORY_AND_DISK)
        small = self.terms.count() <= SMALL  # of the terms, and so of all that is made of them
        self.hinted = F.broadcast if small else lambda x: x
        self.postings = postings(docs, key, text, self.hinted(self.terms.select("term").distinct())).persist(StorageLevel.MEMORY_AND_DISK)

    def few(self, cells: int) -> bool:
        """Whether a matrix of terms and queries has at most so many cells."""
        n = self.terms.agg(F.count_distinct("term").alias("t"), F.count_distinct("query").alias("q")).first()
        return n["t"] * n["q"] <= cells

    def _part(self) -> Column:
        return F.col("times") * F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("size") / self.average))

    def scores(self, terms: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """(query, doc, score) of the pairs that share one of the terms, or of given pairs (q, d) alone."""
        t = (self.terms if terms is None else terms).withColumnRenamed("term", "t")
        p = self.postings
        if pairs is not None:
            p = p.join(pairs, F.col("doc") == F.col("d"))
            on = (F.col("term") == F.col("t")) & (F.col("query") == F.col("q"))
        else:
            on = F.col("term") == F.col("t")
        return p.join(self.hinted(t), on).groupBy("query", "doc").agg(F.sum(self._part()).alias("score"))

    def top(self, pool: int, rare: float = 0.02, few: int = 1000, direct: int = 20_000_000) -> DataFrame:
        """Each query's best `pool` pairs and their rank, exact.

        A term of a few documents can lift a score; a frequent one adds at most
        its weight times (k1 + 1). Scores from the rare terms alone give each
        query a bar: a document that cannot pass it with all frequent terms is
        out, one without a rare term too. A query for which that proves nothing
        is scored in full. Without this each frequent word pairs every query
        that has it with most documents. Where the postings meet the queries in
        `direct` rows at most, scoring them all is the shorter plan to the same
        result.
        """
        if (self.terms.agg(F.sum("df")).first()[0] or 0) <= direct:
            return ranked(self.scores(), pool)
        seldom = self.terms.where(F.col("df") <= F.greatest(F.lit(few), F.lit(int(rare * self.n))))
        often = self.terms.where(F.col("df") > F.greatest(F.lit(few), F.lit(int(rare * self.n))))
        more = often.groupBy(F.col("query").alias("q")).agg(F.sum(F.greatest(F.lit(0.0), F.col("times") * F.col("idf") * (self.k1 + 1))).alias("more"), F.sum(F.least(F.lit(0.0), F.col("times") * F.col("idf") * (self.k1 + 1))).alias("less"))
        part = self.scores(seldom).persist(StorageLevel.MEMORY_AND_DISK)
        w = Window.partitionBy("query").orderBy(F.desc("score"))
        bar = part.withColumn("i", F.row_number().over(w)).where(F.col("i") == pool).select(F.col("query").alias("q"), F.col("score").alias("bar"))
        asked = self.terms.select(F.col("query").alias("q")).distinct()
        state = asked.join(more, "q", "left").join(bar, "q", "left").select("q", F.coalesce("more", F.lit(0.0)).alias("more"), (F.col("bar") + F.coalesce("less", F.lit(0.0))).alias("bar"))
        # what is equal to six places ties, so a pair may fall short by that much
        sure = state.where(F.col("more") + 1e-5 < F.col("bar"))
        chosen = part.join(self.hinted(sure), F.col("query") == F.col("q")).where(F.col("score") + F.col("more") + 1e-5 >= F.col("bar")).select("q", F.col("doc").alias("d"))
        unsure = self.terms.join(self.hinted(sure.select("q")), F.col("query") == F.col("q"), "left_anti")
        return ranked(self.scores(pairs=chosen).unionByName(self.scores(unsure)), pool)


def bm25(docs: DataFrame, queries: DataFrame, **names) -> DataFrame:
    """(query, doc, score) of every pair that shares a term.

    A term in more than half the documents gets `floor` times the mean idf in
    place of its negative one. Only the queries' terms are looked up: the
    join is on the term, and a pair's score is summed from partial sums.
    """
    return Index(docs, queries, **names).scores()


def bm25_top(docs: DataFrame, queries: DataFrame, pool: int, **names) -> DataFrame:
    """(query, doc, score, rank) of each query's best `pool` documents."""
    return Index(docs, queries, **names).top(pool)


def char_grams(text, low: int = 3, high: int = 6):
    """Character n-grams of each word with a space on both sides."""
    padded = F.transform(words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int):
        return lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n)))

    return let(padded, lambda p: F.flatten(F.concat(*[F.transform(p, of(n)) for n in range(low, high + 1)])))


def grams_of(words_: list[str], times: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct character n-grams of distinct words and how often they stand in all, a word counting `times`.

    An n-gram is a whole number of its letters' places among the words'
    letters; where six of those don't fit 63 bits, each half has fewer letters.
    """
    if not words_:
        return [], np.empty(0, np.int64)
    letters, c = np.unique(np.frombuffer("".join(f" {w} " for w in words_).encode("utf-32-le"), "<u4"), return_inverse=True)
    bits = max(1, (len(letters) - 1).bit_length())
    if 6 * bits > 63 and len(words_) > 1:
        half = len(words_) // 2
        a, b = grams_of(words_[:half], times[:half]), grams_of(words_[half:], times[half:])
        return a[0] + b[0], np.concatenate((a[1], b[1]))
    size = np.array([len(w) + 2 for w in words_], np.int64)
    if 6 * bits > 63:
        found: Counter[str] = Counter()
        p = f" {words_[0]} "
        for n in range(3, 7):
            found.update(p[k : k + n] for k in range(max(len(p) - n + 1, 1)))
        return list(found), np.array(list(found.values()), np.int64) * times[0]
    room = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # to the word's end
    whole = np.repeat(size, size)
    count = np.repeat(times, size)
    grams, counts = [], []
    for n in range(3, 7):
        at = np.flatnonzero(room >= n)
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key |= c[at + k] << bits * k
        # a shorter word is its own n-gram for each greater n
        distinct, which = np.unique(key, return_inverse=True)
        counts.append(np.bincount(which, count[at] * np.where(whole[at] == n, 7 - n, 1), len(distinct)).astype(np.int64))
        text = letters[(distinct[:, None] >> (bits * np.arange(n))) & ((1 << bits) - 1)].astype("<u4").tobytes().decode("utf-32-le")
        grams += [text[k : k + n] for k in range(0, len(text), n)]
    return grams, np.concatenate(counts)


def top_grams(seen: DataFrame, features: int, step: int = 200_000) -> DataFrame:
    """(g): the most frequent character n-grams of counted words, ties by the n-gram; those of a distinct word are made once, and count as often as it does."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            grams, counts = grams_of(t.column("term").to_pylist(), t.column("n").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["g", "n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= step:
                yield out()
        if held:
            yield out()

    return seen.select("term", "n").mapInArrow(made, "g string, n long").groupBy("g").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "g").limit(features).select("g")


class Vocabulary:
    """Counts of the n-grams of a vocabulary in texts that are lower-cased and squeezed already, by a trie that all places enter at once."""

    def __init__(self, grams: list[str], dense: int = 8_000_000) -> None:
        self.size = len(grams)
        letters = sorted({c for g in grams for c in g})
        self.letter = np.zeros(0x110000, np.int64)  # 0: in no n-gram
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number, edges = {"": 1}, {}
        for g in grams:
            for k in range(1, len(g) + 1):
                if g[:k] not in number:
                    number[g[:k]] = len(number) + 1
                    edges[number[g[: k - 1]] * self.width + int(self.letter[ord(g[k - 1])])] = number[g[:k]]
        nodes = len(number) + 1
        self.feature, self.times = np.full(nodes, -1, np.int64), np.ones(nodes)
        for i, g in enumerate(grams):
            self.feature[number[g]] = i
            if g[0] == g[-1] == " ":  # a word shorter than n is its own n-gram
                self.times[number[g]] = 7 - len(g)
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[int(k)] for k in self.keys], np.int64)
        self.table = None
        if nodes * self.width <= dense:
            self.table = np.zeros(nodes * self.width, np.int32)
            self.table[self.keys] = self.next

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state * self.width + letter
        if self.table is not None:
            return self.table[key].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], 0)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """A row a text, a column an n-gram. No n-gram has a space inside, so none goes over a word's or a text's end."""
        padded = [f" {x or ''} " for x in texts.to_pylist()]
        c = self.letter[np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")]
        row = np.repeat(np.arange(len(padded)), [len(x) for x in padded])
        at, state = np.arange(len(c)), np.ones(len(c), np.int64)
        cells, times = [], []
        for k in range(6):
            inside = at + k < len(c)
            at, state = at[inside], state[inside]
            state = self._step(state, c[at + k])
            at, state = at[state > 0], state[state > 0]
            hit = self.feature[state] >= 0
            cells.append(row[at[hit]] * self.size + self.feature[state[hit]])
            times.append(self.times[state[hit]])
        return np.bincount(np.concatenate(cells), np.concatenate(times), len(padded) * self.size).reshape(len(padded), self.size)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear tf-idf rows of length 1; rows without an n-gram stay 0."""
    w = np.log(counts, out=np.full(counts.shape, -1.0), where=counts > 0)
    w += 1
    w *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", w, w))
    norm[norm == 0] = 1
    w /= norm[:, None]
    return w


class Cosine:
    """Cosine of sublinear tf-idf over the most frequent character n-grams, and BM25 beside it, against queries that fit a matrix.

    The vocabulary is counted over distinct words, and a document is a row of
    counts within its task: n-grams leave it neither for their documents'
    frequencies nor for the scores.
    """

    #: Queries and n-grams of a matrix that goes to every task; more are joined.
    MOST = 4_000_000
    #: Cells of the counts of one step.
    CELLS = 4_000_000

    @staticmethod
    def fits(queries: DataFrame, features: int) -> bool:
        most = Cosine.MOST // max(1, features)
        return queries.limit(most + 1).count() <= most

    def __init__(self, docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, features: int, seen: DataFrame | None = None) -> None:
        self.grams = [r[0] for r in top_grams(word_counts(docs, text) if seen is None else seen, features).collect()]  # at most `features`
        squeezed = squeeze(F.lower(text)).alias("text")
        self.key_type = docs.schema[key].dataType
        self.query_type = queries.schema[query].dataType
        self.docs = docs.select(F.col(key).alias("doc"), squeezed)
        steps, grams = self._steps, self.grams

        def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(grams), np.int64)
            for _, counts in steps(batches, grams):
                found += (counts > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grams))), pa.array(found)], ["i", "df"])

        df = np.zeros(len(grams), np.int64)
        for r in self.docs.select("text").mapInArrow(having, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).collect() if grams else []:
            df[r["i"]] = r["df"]
        n = docs.count()
        self.idf = np.log((1 + n) / (1 + df)) + 1
        texts: dict = {}  # of queries that share an id
        for q, x in queries.select(query, squeeze(F.lower(query_text))).where(F.col(query).isNotNull()).collect():
            texts.setdefault(q, []).append(x)
        self.ids = list(texts)
        v = Vocabulary(grams)
        counts = v.counts(pa.array([" ".join(filter(None, x)) for x in texts.values()], pa.string())) if grams and texts else np.zeros((len(texts), len(grams)))
        self.asked = weighed(counts, self.idf)
        # rows that share an id are one document; a row without one is none
        again = _small(self.docs.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("again")).persist(StorageLevel.MEMORY_AND_DISK))
        self.whole = self.docs.where("doc IS NOT NULL")
        if again.limit(1).count():
            merged = self.whole.join(again, F.col("doc") == F.col("again"), "left_semi").groupBy("doc").agg(F.trim(F.array_join(F.filter(F.collect_list("text"), lambda x: x != ""), " ")).alias("text"))
            self.whole = self.whole.join(again, F.col("doc") == F.col("again"), "left_anti").unionByName(merged)

    @staticmethod
    def _steps(batches: Iterator[pa.RecordBatch], grams: list[str], more: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        v = Vocabulary(grams)
        rows = max(1, Cosine.CELLS // max(1, len(grams), more))
        for batch in batches:
            for s in range(0, batch.num_rows, rows):
                part = batch.slice(s, rows)
                yield part, v.counts(part.column("text"))

    def _typed(self, *scores: str) -> tuple[str, pa.DataType]:
        """The schema of (query, doc, ...) and the Arrow type of its query."""
        schema = ", ".join([f"query {self.query_type.simpleString()}", f"doc {self.key_type.simpleString()}", *scores])
        return schema, self.docs.sparkSession.createDataFrame([], schema).toArrow().schema.field("query").type

    def scores(self) -> DataFrame:
        """(query, doc, score) of all pairs that share an n-gram."""
        schema, query_type = self._typed("score double")
        steps, grams, idf, ids, asked = self._steps, self.grams, self.idf, self.ids, self.asked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(ids, query_type)
            for part, counts in steps(batches, grams):
                scores = weighed(counts, idf) @ asked.T
                row, column = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(column)), part.column("doc").take(pa.array(row)), pa.array(scores[row, column])], ["query", "doc", "score"])

        return self.whole.mapInArrow(run, schema) if ids and grams else self.docs.sparkSession.createDataFrame([], schema)

    def best(self, index: Index, pool: int) -> DataFrame:
        """(query, doc, bm25, cosine, by_bm25, by_cosine): pairs among which are each query's best `pool` by either score, and which one chose them.

        Both scores come from one pass, and each step keeps its best alone.
        """
        schema, query_type = self._typed("bm25 double", "cosine double", "by_bm25 boolean", "by_cosine boolean")
        steps, grams, idf, ids = self._steps, self.grams, self.idf, self.ids
        if not ids:
            return self.docs.sparkSession.createDataFrame([], schema)
        used = np.flatnonzero(self.asked.any(axis=0))
        asked = np.ascontiguousarray(self.asked[:, used].T)
        number, rows = {q: i for i, q in enumerate(ids)}, index.terms.where("query IS NOT NULL").select("query", "term", "times", "idf").collect()
        terms = list(dict.fromkeys(r["term"] for r in rows))
        place = {w: i for i, w in enumerate(terms)}
        weight, has = np.zeros((len(terms), len(ids))), np.zeros((len(terms), len(ids)))
        for r in rows:
            weight[place[r["term"]], number[r["query"]]] = r["times"] * r["idf"]
            has[place[r["term"]], number[r["query"]]] = 1
        positive = bool((weight[has > 0] > 0).all())
        k1, b, average = index.k1, index.b, index.average or 1.0

        def matched(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The BM25 scores, and which pairs share a term."""
            split = pc.split_pattern(texts, " ")
            each = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(split.flatten(), value_set=pa.array(terms, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), each)[found >= 0]
            tf = np.bincount(row * len(terms) + found[found >= 0], minlength=len(texts) * len(terms)).reshape(len(texts), len(terms)).astype(float)
            size = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, each)
            scores = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average)[:, None])) @ weight
            return scores, scores > 0 if positive else (tf > 0).astype(float) @ has > 0

        def chosen(scores: np.ndarray, some: np.ndarray) -> np.ndarray:
            # what is equal to six places ties, so the last place may go to a pair that falls short by that much
            x = np.where(some, scores, -np.inf)
            return some & (x >= np.partition(x, -pool, axis=0)[-pool] - 2e-6) if len(x) > pool else some

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(ids, query_type)
            for part, counts in steps(batches, grams, len(terms)):
                y = weighed(counts, idf)[:, used] @ asked
                x, shared = matched(part.column("text"))
                by_x, by_y = chosen(x, shared), chosen(y, y > 0)
                row, column = np.nonzero(by_x | by_y)
                got = [names.take(pa.array(column)), part.column("doc").take(pa.array(row)), pa.array(x[row, column], mask=~shared[row, column]), pa.array(y[row, column])]
                yield pa.RecordBatch.from_arrays([*got, pa.array(by_x[row, column]), pa.array(by_y[row, column])], ["query", "doc", "bm25", "cosine", "by_bm25", "by_cosine"])

        return self.whole.mapInArrow(run, schema)


def cosine(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", features: int = FEATURES) -> DataFrame:
    """(query, doc, score): cosine of sublinear tf-idf over the most frequent character n-grams (ties by the n-gram).

    Few queries are a matrix (`Cosine`). Otherwise the n-grams are counted
    where they lie, and only those of the vocabulary and of some query go
    through an exchange by document.
    """
    if Cosine.fits(queries, features):
        return Cosine(docs, queries, key, text, query, query_text, features).scores()
    grams = docs.select(F.col(key).alias("k"), char_grams(F.col(text)).alias("g"))
    n = docs.count()
    total = top_grams(word_counts(docs, text), features)
    inside = grams.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("g", "h")
    idf = total.join(inside, F.col("g") == F.col("h")).select(F.col("g").alias("v"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")).persist(StorageLevel.MEMORY_AND_DISK)  # at most `features` rows

    def weights(x: DataFrame) -> DataFrame:
        d = x.select("k", F.explode("g").alias("g")).join(F.broadcast(idf), F.col("g") == F.col("v")).groupBy("k", "g").agg(F.count(F.lit(1)).alias("c"), F.first("idf").alias("idf"))
        return d.select("k", "g", ((1 + F.log("c")) * F.col("idf")).alias("w"))

    def unit(w: DataFrame) -> DataFrame:
        norm = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).withColumnRenamed("k", "norm_of")
        return w.join(norm, F.col("k") == F.col("norm_of")).select("k", "g", (F.col("w") / F.col("norm")).alias("w"))

    a = unit(weights(grams)).select(F.col("k").alias("doc"), "g", "w")
    asked = queries.select(F.col(query).alias("k"), char_grams(F.col(query_text)).alias("g"))
    q = unit(weights(asked)).select(F.col("k").alias("query"), F.col("g").alias("h"), F.col("w").alias("qw"))
    return a.join(_small(q), F.col("g") == F.col("h")).groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def ranked(scores: DataFrame, pool: int) -> DataFrame:
    """Each query's best `pool` documents with rank from 0; scores equal to six places tie, and go by the document.

    Spark cuts each task's rows to the pool before the exchange.
    """
    w = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < pool)


def fused(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (query, doc, score)."""
    u = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        u = u.unionByName(r.select("query", "doc", "rank"))
    return u.groupBy("query", "doc").agg(F.sum(1 / (k + F.col("rank") + 1)).alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, top: int = 3, least_bm25: float = 0.5, least_cosine: float = 0.15, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", exclude_same: bool = False) -> DataFrame:
    """(query, doc, score, rank): each query's documents by both rankings, those that pass either gate, the best `top`.

    Pools of ten times `top` are fused before anything is left out; with
    `exclude_same` a document of the query's own text is no answer to it.
    """
    pool = candidates(docs, queries, top, least_bm25, least_cosine, key, text, query, query_text, exclude_same)
    return ranked(pool, top)


def candidates(docs: DataFrame, queries: DataFrame, top: int, least_bm25: float, least_cosine: float, key: str, text: str, query: str, query_text: str, exclude_same: bool) -> DataFrame:
    """(query, doc, score) of the fused pools' documents that pass a gate."""
    index = Index(docs, queries, key, text, query, query_text)
    pool = 10 * top
    if Cosine.fits(queries, FEATURES) and index.few(Cosine.MOST):
        both = Cosine(docs, queries, key, text, query, query_text, FEATURES, index.words).best(index, pool).persist(StorageLevel.MEMORY_AND_DISK)
        best = fused([ranked(both.where(f"by_{by}").select("query", "doc", F.col(by).alias("score")), pool) for by in ("bm25", "cosine")])
        d = best.join(both.select("query", "doc", "bm25", "cosine"), ["query", "doc"])
    else:
        y = cosine(docs, queries, key, text, query, query_text).persist(StorageLevel.MEMORY_AND_DISK)
        best = fused([index.top(pool), ranked(y, pool)]).persist(StorageLevel.MEMORY_AND_DISK)  # 20 * top rows a query at most
        pairs = best.select(F.col("query").alias("q"), F.col("doc").alias("d"))
        x = index.scores(pairs=pairs).withColumnRenamed("score", "bm25")
        d = best.join(x, ["query", "doc"], "left").join(y.withColumnRenamed("score", "cosine"), ["query", "doc"], "left")
    d = d.where((F.coalesce("bm25", F.lit(0.0)) >= least_bm25) | (F.coalesce("cosine", F.lit(0.0)) >= least_cosine)).select("query", "doc", "score")
    if exclude_same:
        a = docs.select(F.col(key).alias("own_doc"), F.trim(text).alias("doc_text"))
        b = queries.select(F.col(query).alias("own_query"), F.trim(query_text).alias("own_text"))
        d = d.join(a, F.col("doc") == F.col("own_doc")).join(b, F.col("query") == F.col("own_query")).where(~F.col("doc_text").eqNullSafe(F.col("own_text"))).select("query", "doc", "score")
    return d


def examples(pairs: DataFrame, key: str, source: str, target: str, queries: DataFrame, query: str, query_text: str, top: int = 3, max_example: int = 200, budget: int = 256, least_bm25: float = 0.5, least_cosine: float = 0.15, exclude_same: bool = True) -> DataFrame:
    """(query, examples): for each query the pairs to show it, as "source => target", best first.

    A pair longer than `max_example` bytes is passed over; the first that
    would pass the budget of bytes ends the list, as does the `top`-th.
    """
    pool = candidates(pairs, queries, top, least_bm25, least_cosine, key, source, query, query_text, exclude_same)
    shown = pairs.select(F.col(key).alias("own_key"), F.concat(F.trim(source), F.lit(" => "), F.trim(target)).alias("shown"))
    d = ranked(pool, 20 * top).join(shown, F.col("doc") == F.col("own_key")).where(F.octet_length("shown") <= max_example)
    listed = d.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]).alias("shown"))  # 20 * top rows a query at most
    return listed.select("query", windows.budget_prefix(F.col("shown"), F.octet_length, budget, top).alias("examples")).where(F.size("examples") > 0)


def precomputed(pairs: DataFrame, key: str, source: str, target: str, **options) -> DataFrame:
    """(query, examples) of every row of a table against the table itself, its own text excluded."""
    return examples(pairs, key, source, target, pairs, key, source, exclude_same=True, **options)
