"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two are linked at 3 or fewer differing bits, so
they differ in at most one bit in one of the 32-bit halves. The anchors of a
half are the words of a perfect covering code: the binary Hamming code of
length 31 on its low bits, and its top bit as it is: 2^27 anchors with
covering radius 1. A fingerprint's home is the anchor within radius 1; it is
sent to every anchor within 2 (covering radius plus the half's threshold of
1): at most 17 a half. Two linked fingerprints then meet at a home of one of
them, and are compared there.

Equal fingerprints are merged before anything is sent, and an anchor's group
gives a spanning forest of its links, never all its pairs. Anchors near halves
that more than `hot` fingerprints have are found beforehand; their groups are
dealt by the four bytes of the other half before the exchange (of four bytes,
three differing bits leave one equal), so that no task holds a hot group.
Components come from alternating stars over those edges.

Defined results: a null, empty or word-less text has fingerprint zero, which
links like any other; repeated rows share a component; the component id is
the smallest doc_id in it, null only if all of them are; an empty table gives
an empty table. Extra columns are left out, but `deduplicate` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, narrow, persisted, unused
from quern.llm.graph import components

THRESHOLD = 3
#: For each byte, eight one-byte counters: byte j is bit j.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)
#: Each position 1 to 31 in binary, for syndromes of the Hamming code: bit p - 1 of a word has position p.
_SYNDROME_MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], "<u8")
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    # up to 255 rows fit a one-byte counter
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _digest(text: Column) -> Column:
    """What tells rows that share an id apart; empty for a null text."""
    return F.coalesce(F.unhex(F.md5(text.cast("string"))), F.lit(b""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, with_digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; with_digest adds the text's digest."""
    d = narrow(docs, id_col, text_col)
    if with_digest:
        d = d.withColumn("digest", _digest(F.col("text")))
    names = ["doc_id", "fp", *d.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names)

    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long" + ", digest binary" * with_digest)


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp & np.uint64(0xFFFFFFFF)).astype(np.uint64), fp >> np.uint64(32)]


def _syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), np.int64)
    for j, mask in enumerate(_SYNDROME_MASKS):
        s |= (np.bitwise_count(half & np.uint64(mask)).astype(np.int64) & 1) << j
    return s


def _patterns() -> list[np.ndarray]:
    """For each syndrome, the error patterns of weight up to 2 over 32 bits that lead to an anchor; the first leads home."""
    out = []
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        far = [(1 << (i - 1)) | (1 << (j - 1)) for i in range(1, 32) for j in range(i + 1, 32) if i ^ j == s]
        out.append(np.array([home, home | 1 << 31, *far], np.uint64))
    return out


_PATTERNS = _patterns()


def homes(fp: np.ndarray, side: int) -> np.ndarray:
    """The key of each fingerprint's home anchor: the half's number above the anchor."""
    half = _halves(fp)[side]
    table = np.array([p[0] for p in _PATTERNS], np.uint64)
    return (half ^ table[_syndrome(half)]) | np.uint64(side << 32)


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) of every anchor within covering radius plus threshold, for both halves."""
    sides = [anchors_near(half, np.full(len(fp), side, np.uint64)) for side, half in enumerate(_halves(fp))]
    return np.concatenate([key for key, _ in sides]), np.concatenate([fp[at] for _, at in sides])


def anchors_near(half: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index): the anchors within covering radius plus threshold of each half, which is one of the given side."""
    s = _syndrome(half)
    keys, index = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k in np.unique(s).tolist():
        at, p = np.flatnonzero(s == k), _PATTERNS[k]
        keys.append(((half[at] | side[at] << np.uint64(32))[:, None] ^ p[None, :]).ravel())
        index.append(np.repeat(at, len(p)))
    return np.concatenate(keys), np.concatenate(index)


def forest(u: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Adds a spanning forest of the links within the distinct fingerprints u."""
    left = u
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                got = left[near]
                out.extend((int(x), int(y)) for y in got)
                frontier.extend(got)
                left = left[~near]


def group_links(u: np.ndarray, side: int, out: list[tuple[int, int]], large: int = 2048) -> None:
    """The links of one anchor's group. A large group is dealt by the bytes of the other half first: of four, three bits leave one equal."""
    if len(u) <= large:
        forest(u, out)
        return
    other = _halves(u)[1 - side]
    for k in range(4):
        byte = (other >> np.uint64(8 * k)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for part in np.split(u[order], np.flatnonzero(np.diff(byte[order])) + 1):
            forest(part, out)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in key order; a group may stretch over batches. The key's lowest 33 bits are the anchor's."""

    def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        side = ((key >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
        home = np.zeros(len(key), bool)
        for k in (0, 1):
            at = side == k
            home[at] = homes(fp[at], k) == key[at] & np.uint64((1 << 33) - 1)
        has = np.add.reduceat(home, starts) > 0 if len(key) else np.empty(0, bool)
        for i in np.flatnonzero(has & (stops - starts > 1)):
            group_links(fp[starts[i] : stops[i]], int(side[starts[i]]), out)
        ab = np.array(sorted(set(out)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    keys: list[np.ndarray] = []  # of the group that may go on; joined once, when it ends
    fps: list[np.ndarray] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        if keys and key[-1] == keys[0][0]:
            keys.append(key)
            fps.append(fp)
            continue
        whole = int(np.searchsorted(key, key[-1]))
        if keys or whole:
            yield done(np.concatenate([*keys, key[:whole]]), np.concatenate([*fps, fp[:whole]]))
        keys, fps = [key[whole:]], [fp[whole:]]
    if keys:
        yield done(np.concatenate(keys), np.concatenate(fps))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]


def _keyed(key: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, fp, *more)], ["key", "fp", "part"][: 2 + len(more)])


def links(prints: DataFrame, fp: str = "fp", hot: int = 1 << 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that are linked."""
    distinct = persisted(prints.select(F.col(fp).alias("fp")).distinct())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _keyed(*replicas(_columns(batch)[0]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, n = _columns(batch)
            key, at = anchors_near(half & np.uint64(0xFFFFFFFF), half >> np.uint64(32))
            yield _keyed(key, n[at])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, u = _columns(batch)
            side = (key >> np.uint64(32)) & np.uint64(1)
            other = np.where(side == 0, u >> np.uint64(32), u & np.uint64(0xFFFFFFFF))
            for k in range(4):  # the group of an anchor and a byte of the other half
                yield _keyed(key, u, np.uint64(k << 8) | (other >> np.uint64(8 * k)) & np.uint64(255))

    sent = map_arrow(distinct, spread, "key long, fp long")
    # 529 halves are near an anchor: one of more than 2 `hot` fingerprints has more than `hot` from halves of more than hot / 529
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32)
    heavy = distinct.select(F.explode(F.array(low, high)).alias("half")).groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot / 529)
    crowded = map_arrow(heavy, near, "key long, fp long").groupBy("key").agg(F.sum("fp").alias("n")).where(F.col("n") > hot)
    crowded = persisted(crowded.select(F.col("key").alias("crowd")))
    cool = sent
    if not crowded.isEmpty():
        cool = sent.join(crowded, F.col("key") == F.col("crowd"), "left_anti")
    # keys are below 2^33, so their signed order is their unsigned order
    found = map_arrow(cool.repartition(F.col("key")).sortWithinPartitions("key"), _compare, "a long, b long")
    if cool is sent:
        return found
    dealt = map_arrow(sent.join(crowded, F.col("key") == F.col("crowd"), "left_semi"), deal, "key long, fp long, part long")
    # the part goes above the key's 33 bits, so that a group is one run of equal numbers again
    dealt = dealt.select((F.col("part") * F.lit(1 << 33) + F.col("key")).alias("key"), "fp")
    return found.unionByName(map_arrow(dealt.repartition(F.col("key")).sortWithinPartitions("key"), _compare, "a long, b long"))


def _firsts(prints: DataFrame, least: Column) -> DataFrame:
    """(k, first): of each distinct fingerprint k, the smallest `least` (an aggregate that takes a minimum) of its component."""
    nodes = persisted(components(links(prints)))
    of_print = prints.groupBy("fp").agg(least.alias("least"))
    of_fp = persisted(of_print.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"))
    # written, so that the join meets exchanges on both sides and a large component can be split
    of_component = persisted(of_fp.groupBy("component").agg(F.min("least").alias("first")))
    return of_fp.join(of_component, "component").select(F.col("fp").alias("k"), "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id (the smallest doc_id linked to it, directly or not)."""
    prints = persisted(fingerprints(docs, id_col, text_col, width))
    ids = _firsts(prints, F.min("doc_id"))
    return prints.join(ids, F.col("fp") == F.col("k")).select("doc_id", "fp", F.col("first").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of `docs`, all columns: that of the smallest id, null last, and of its texts the one of the smallest digest.

    A row is told by its id and its text's digest, so null and repeated ids
    cost no other row; of rows alike in both one stays.
    """
    prints = persisted(fingerprints(docs, id_col, text_col, with_digest=True))
    ids = _firsts(prints, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    found = persisted(prints.join(ids, F.col("fp") == F.col("k")).select("doc_id", "digest", first.alias("first")))
    row, own = unused("row_id", docs), unused("row_digest", docs)  # names that no column of `docs` has
    found = found.select(F.col("doc_id").alias(row), F.col("digest").alias(own), "first")

    def is_row(d: DataFrame) -> Column:
        return d[id_col].eqNullSafe(F.col(row)) & (_digest(d[text_col]) == F.col(own))

    kept = docs.join(found.where("NOT first").select(row, own).distinct(), is_row(docs), "left_anti")
    twice = persisted(found.where("first").groupBy(row, own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return kept
    same = kept.join(twice, is_row(kept), "left_semi").withColumn(own, _digest(F.col(text_col))).dropDuplicates([id_col, own]).drop(own)
    return kept.join(twice, is_row(kept), "left_anti").unionByName(same)
