"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII
characters. Each benchmark text gives its windows of `window` consecutive
words (a shorter one is a single window). All windows go into one automaton;
each document's normalised text is scanned once, matches are mapped to word
places and from there to offsets in the original text.

Memory: the windows' size is measured before anything is sent. Up to
`max_pattern_bytes` of them the benchmark texts are broadcast, and each
worker builds one automaton, once, for one scan. Beyond, the texts are cut
into pieces that overlap by a window less a word, so that each window is in
one piece, however long an item is; pieces are dealt into blocks whose sizes
are measured too, each block is scanned in its own pass, and a document's
hits are merged: exact at any benchmark size.

Defined results: null or empty texts have no words and no hits; benchmark
items without words never match; equal items both match; items with a null id
match and count as one; an empty benchmark hits nothing; repeated documents
are judged alike. Extra columns, clashing names included, are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ALNUM_TABLE, map_arrow, narrow, unused

_HITS = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def normal(text: str | None) -> list[bytes]:
    """The words of a text as lower-cased UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def windows(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def automaton(items: list[tuple[str | None, str | None]], size: int) -> ahocorasick.Automaton | None:
    """Patterns are windows between spaces, so that only whole words match; a pattern's value is its words and items."""
    found: dict[bytes, tuple[int, set[str | None]]] = {}
    for item, text in items:
        for w in windows(normal(text), size):
            found.setdefault(w, (w.count(b" ") + 1, set()))[1].add(item)
    if not found:
        return None
    a = ahocorasick.Automaton()
    for w, (n, ids) in found.items():
        # latin-1 maps each byte to one character, and so keeps byte offsets
        a.add_word(f" {w.decode('latin-1')} ", (n, tuple(ids)))
    a.make_automaton()
    return a


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def automaton_of(name: str, items: list[tuple[str | None, str | None]], size: int) -> ahocorasick.Automaton | None:
    """The automaton of one scan, built once in a worker; the last ones stay."""
    if name not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = automaton(items, size)
    return _BUILT[name]


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, max_pattern_bytes: int) -> tuple[DataFrame, int]:
    """(item, text, block) of the benchmark's texts, or of their pieces, and the number of blocks, none over the bound or two pieces."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    # a text's windows are at most `window` times as long in sum as it is
    size = (b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * window
    if size <= max_pattern_bytes:
        return b.withColumn("block", F.lit(0)), 1
    step = max(1, min(4096, max_pattern_bytes // (64 * window)))
    words = F.filter(F.split(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")
    d = b.select("item", words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step))
    d = d.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.expr(f"slice(w, at + 1, {step + window - 1})"), " ").alias("text"))
    length = F.octet_length("text") * window
    total, longest = d.agg(F.sum(length), F.max(length)).first()
    bound = max(max_pattern_bytes, 2 * (longest or 0))  # no block is less than a piece, however long its words
    blocks = first = -(-3 * (total or 0) // (2 * bound)) or 1
    while True:
        dealt = d.withColumn("block", F.pmod(F.xxhash64("text", "item"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum(length).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= bound or blocks >= 64 * first:  # equal pieces of equal items go together
            return dealt, blocks
        blocks *= 2


def scan(a: ahocorasick.Automaton | None, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Maximal runs [first, last] of hit words, and the items with a window in the text."""
    if a is None or not words:
        return [], set()
    ends: list[int] = []
    sizes: list[int] = []
    items: set[str | None] = set()
    for end, (n, ids) in a.iter(f" {b' '.join(words).decode('latin-1')} "):
        ends.append(end)
        sizes.append(n)
        items.update(ids)
    if not ends:
        return [], items
    # the space that ends a match stands right after the last word's final byte
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(stops, np.array(ends))
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted(zip((last - np.array(sizes) + 1).tolist(), last.tolist(), strict=True)):
        if runs and lo <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        else:
            runs.append((lo, hi))
    return runs, items


def word_spans(text: str) -> list[tuple[int, int]]:
    """Each word's [start, end) in the code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(ALNUM_TABLE), np.uint8)
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    inside = np.concatenate(([False], b != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts = at[edge[::2]] - 1
    stops = at[edge[1::2] - 1]
    return list(zip(starts.tolist(), stops.tolist(), strict=True))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_pattern_bytes: int = 64 << 20, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, hits (runs of hit words), items (sorted as strings); with_text adds text."""
    d = narrow(docs, id_col, text_col)
    b, blocks = blocks_of(benchmark, item_id, item_text, window, max_pattern_bytes)

    def one(block: int) -> DataFrame:
        items = [(r["item"], r["text"]) for r in b.where(F.col("block") == block).collect()]  # bounded by max_pattern_bytes
        shared, name = d.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton_of(name, shared.value, window)
            for batch in batches:
                n, runs, found = [], [], []
                for text in batch.column(1):
                    words = normal(text.as_py())
                    got, ids = scan(a, words)
                    n.append(len(words))
                    runs.append([{"first": x, "last": y} for x, y in got])
                    found.append(sorted(ids, key=lambda x: (x is None, x)))  # null last
                texts = batch.column(1)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
                names = ["doc_id", "n_words", "hits", "items"]
                if with_text:
                    cols, names = [*cols, texts], [*names, "text"]
                if blocks > 1:  # tells rows that share an id apart
                    digests = [hashlib.md5(t.as_py().encode("utf-8", "surrogatepass")).digest() if t.is_valid else None for t in texts]
                    cols, names = [*cols, pa.array(digests, pa.binary())], [*names, "digest"]
                yield pa.RecordBatch.from_arrays(cols, names)

        return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_HITS}" + ", text string" * with_text + ", digest binary" * (blocks > 1))

    if blocks == 1:
        return one(0)
    # each block adds its runs; a row number is not needed, as equal rows have equal hits
    keys = ["doc_id", "n_words", "digest", *["text"] * with_text]
    whole = one(0)
    for k in range(1, blocks):
        whole = whole.unionByName(one(k))
    # equal rows are counted per block, and come back as often as they were
    merged = whole.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count(F.lit(1)).alias("c"))
    join = "aggregate(h, cast(array() as array<struct<first:long,last:long>>), (a, x) -> if(size(a) > 0 and x.first <= element_at(a, -1).last + 1, concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))), concat(a, array(x))))"
    merged = merged.withColumn("hits", F.expr(join)).withColumn("c", F.explode(F.sequence(F.lit(1), (F.col("c") / blocks).cast("int"))))
    return merged.select("doc_id", "n_words", "hits", "items", *["text"] * with_text)


def decided(found: DataFrame, min_percent: int = 5) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: any hit word, and at least `min_percent` of the words."""
    d = found.withColumns({
        "n_hit": F.expr("aggregate(hits, 0L, (a, x) -> a + x.last - x.first + 1)"),
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
    })
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))


def spans(found: DataFrame) -> DataFrame:
    """Adds `spans`: the hit runs as [start, end) code points of the original text (needs with_text)."""

    import pandas as pd  # not in every worker

    def to_spans(text, runs):
        out = []
        for t, r in zip(text, runs, strict=True):
            at = word_spans(t) if t and len(r) else []
            out.append([{"start": at[x["first"]][0], "end": at[x["last"]][1]} for x in r])
        return pd.Series(out)

    udf = F.pandas_udf(to_spans, "array<struct<start:long,end:long>>", F.PandasUDFType.SCALAR)
    return found.withColumn("spans", udf("text", "hits"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """The rows of `docs`, all columns, whose text is not contaminated.

    Rows pass through one scan, without a join. Beyond one block each distinct
    text is judged once, and rows go by their text alone, never by their id.
    """
    b, blocks = blocks_of(benchmark, item_id, item_text, window, max_pattern_bytes)
    if blocks > 1:
        texts = docs.select(F.md5(F.col(text_col).cast("string")).alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["doc_id"])
        name = unused("bad", docs)
        bad = decided(hits(texts, benchmark, "doc_id", "text", item_id, item_text, window, max_pattern_bytes)).where("contaminated").select(F.col("doc_id").alias(name))
        return docs.join(bad, F.md5(docs[text_col].cast("string")) == F.col(name), "left_anti")
    items = [(r["item"], r["text"]) for r in b.collect()]  # bounded by max_pattern_bytes
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton_of(name, shared.value, window)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                words = normal(text.as_py())
                n = sum(y - x + 1 for x, y in scan(a, words)[0])
                keep.append(not (n > 0 and 20 * n >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
