"""Exact substring deduplication: sorted suffix runs, front-coded, exchanged and merged by loser trees.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Documents are dealt into blocks by ranges of
their id, so that a string of a block is repeated if an earlier block has it,
or an earlier document of its own block; no ids travel.

Not every suffix is sorted. Each string of `length` bytes has an anchor, the
leftmost of its k-mers with the least hash; equal strings have equal anchors
at equal places, and about one byte in twenty starts an anchor. Three rounds
go over the blocks:

1. Each block sends the sorted hashes of two windows an anchor, one of which
   lies within every string it stands for: that from the anchor, for strings
   that begin less than `near` bytes before it, and that around it, for the
   others. Those that two blocks have come back. A window is about two thirds
   of a string: k-mers alone are soon all repeated in a large corpus, and
   nearly all suffixes would travel.
2. For those anchors only, and the strings of their repeated windows, each
   block sends its suffixes (from the anchor, with the bytes before it),
   sorted, distinct and front-coded. Runs are
   combined by a loser tree that keeps, for each head, the prefix it is known
   to share with the last string put out, and never compares it again. From
   the common prefixes to both sides of the anchor it follows which strings
   an earlier block has: one bit each goes back.
3. Each block adds what repeats among its own documents and removes.

The exchange goes in levels of at most `fan` branches. At each level the runs
of a group of blocks meet for one range of hashes, are merged, and are split
into narrower ranges for a wider group, until one narrow range meets all
blocks; answers come back the same way. So a block sends and gets `fan`
messages a level at any size of the corpus, and the levels are a logarithm of
the number of blocks. What a group has more than once is answered there and
goes up once, so that a string that all blocks have is `fan` entries of a
task, not one a block.

Copies of whole texts are known by their digest beforehand and take no part.
A run holds a string once however often the block has it. Memory follows the
block and the range, whose numbers grow with the data.

On disk are the blocks and, of the suffixes, what one level gets and what it
sends: runs travel compressed, the shuffle files of a step go when what it
makes is written, and tables go when the next step has read them. All are
gone before the result is returned.

Defined results: null and empty texts, and those shorter than `length`, lose
nothing; strings within one document, or in rows that share an id, do not
count against each other; a row without id loses nothing and removes nothing;
an empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, narrow, persisted, work_dir

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Kinds of messages to a block: a copy of another text, hashes that repeat, marks of its suffixes.
COPY, REPEATED, EARLIER = 0, 1, 2
_MESSAGE = "up boolean, part long, grp long, data binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))) * _MIX2


def kmer_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer of the bytes b; k is a multiple of 8."""
    w = b.astype(np.uint64)
    for shift in (1, 2, 4):
        w = w[:-shift] | (w[shift:] << np.uint64(8 * shift))
    h = _mixed(w)
    out = h[: len(b) - k + 1].copy()
    for at in range(8, k, 8):
        out = _mixed(out ^ w[at : len(b) - k + 1 + at])
    return out


def window_hashes(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes of b from each place; width is a multiple of 8."""
    if not len(at):
        return np.empty(0, np.uint64)
    w = np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b), 0, (1,))
    h = _mixed(w[at])
    for k in range(8, width, 8):
        h = _mixed(h ^ w[at + k])
    return h


def anchors(b: np.ndarray, room: np.ndarray, length: int, k: int, chunk: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(place, first, last, hash): each anchor, the first and last start of the strings it stands for, its k-mer's hash.

    b holds the documents' bytes one after the other, room the number of
    bytes from each place to its document's end.
    """
    parts: list[list[np.ndarray]] = [[], [], [], []]
    width = length - k + 1
    for s in range(0, max(0, len(b) - length + 1), chunk):
        e = min(s + chunk, len(b) - length + 1)
        h = kmer_hashes(b[s : e + length - 1], k)
        # the place within the chunk breaks ties to the left
        m = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if width > size:
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
        valid = np.flatnonzero(room[s:e] >= length)
        if not len(valid):
            continue
        own = (m[valid] & np.uint64((1 << 21) - 1)).astype(np.int64)
        # strings of one anchor are neighbours, unless a document ends between them
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)))
        start = np.flatnonzero(new)
        stop = np.concatenate((start[1:], [len(own)])) - 1
        for p, x in zip(parts, (own[start] + s, valid[start] + s, valid[stop] + s, h[own[start]]), strict=True):
            p.append(x)
    return tuple(np.concatenate(p) if p else np.empty(0, np.uint64 if i == 3 else np.int64) for i, p in enumerate(parts))


def prefix_lengths(rows: np.ndarray) -> np.ndarray:
    """How long a prefix each row of bytes shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 16):
        a, b = rows[at - 1 : at - 1 + (1 << 16)], rows[at : at + (1 << 16)]
        differs = a[: len(b)] != b
        out[at : at + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as the length of the prefix shared with the row before, and the bytes after it."""
    lcp = prefix_lengths(rows)
    rest = rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]]
    return len(rows).to_bytes(8, "little") + lcp.astype(np.uint8).tobytes() + rest.tobytes()


def front_decode(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, shared prefix lengths) of front_code."""
    n = int.from_bytes(data[:8], "little")
    lcp = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    rest = np.frombuffer(data, np.uint8, offset=8 + n)
    rows = np.zeros((n, width), np.uint8)
    own = np.arange(width)[None, :] >= lcp[:, None]
    rows[own] = rest
    index = np.arange(n)
    for c in range(width):
        rows[:, c] = rows[np.maximum.accumulate(np.where(own[:, c], index, 0)), c]
    return rows, lcp


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of as many whole numbers: each as its first and the differences, in as few bytes as hold them."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = c.astype(np.int64)
        d = np.diff(c)
        low = int(d.min()) if len(d) else 0
        size = next(w for w in (0, 1, 2, 4, 8) if w == 8 or not len(d) or int(d.max()) - low < 1 << 8 * w)
        out += [bytes([size]), c[:1].tobytes(), np.int64(low).tobytes()]
        if size:
            out.append((d - low).astype(f"<u{size}").tobytes())
    return b"".join(out)


def unpack_numbers(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    out, at = [], 8
    for _ in range(columns):
        size = data[at]
        if not n:
            out.append(np.empty(0, np.int64))
            at += 9
            continue
        first, low = np.frombuffer(data, np.int64, 2, at + 1)
        d = np.frombuffer(data, f"<u{size}", n - 1, at + 17).astype(np.int64) if size else np.zeros(n - 1, np.int64)
        out.append(np.cumsum(np.concatenate(([first], d + low))))
        at += 17 + size * (n - 1)
    return out


class LoserTree:
    """Merges sorted runs of strings of one length by their known common prefixes.

    A head's `known` is the prefix it shares with the last string put out. Of
    two heads the one with the longer known prefix comes first, without a look
    at their bytes; at equal lengths they are compared from there on, and the
    loser keeps the prefix it shares with the winner.
    """

    def __init__(self, runs: list[list[bytes]], lcps: list[list[int]]) -> None:
        self.runs, self.lcps = runs, lcps
        n = 1
        while n < max(1, len(runs)):
            n *= 2
        self.n = n
        self.at = [0] * n
        self.known = [0 if i < len(runs) and runs[i] else -1 for i in range(n)]
        self.head = [runs[i][0] if i < len(runs) and runs[i] else b"" for i in range(n)]
        self.loser = [0] * n
        winners = list(range(n))
        level = n // 2
        while level:
            nxt = []
            for j in range(level):
                w, x = self._play(winners[2 * j], winners[2 * j + 1])
                self.loser[level + j] = x
                nxt.append(w)
            winners = nxt
            level //= 2
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return (a, b) if a < b else (b, a)
        x, y = self.head[a], self.head[b]
        if x == y:
            w, lost = (a, b) if a < b else (b, a)
            self.known[lost] = len(x)
            return w, lost
        diff = int.from_bytes(x[ka:], "big") ^ int.from_bytes(y[ka:], "big")
        w, lost = (a, b) if x < y else (b, a)
        self.known[lost] = len(x) - (diff.bit_length() + 7) // 8
        return w, lost

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, prefix shared with the string before) of each string in order."""
        known, loser, n = self.known, self.loser, self.n
        head, at, play = self.head, self.at, self._play
        runs, lcps = self.runs, self.lcps
        w = self.winner
        while known[w] >= 0:
            yield w, known[w]
            i = at[w] = at[w] + 1
            run = runs[w]
            if i < len(run):
                head[w] = run[i]
                known[w] = lcps[w][i]
            else:
                known[w] = -1
            node = (n + w) >> 1
            while node:
                x = loser[node]
                kw, kx = known[w], known[x]
                if kx > kw:
                    loser[node], w = w, x
                elif kx == kw:
                    w, loser[node] = play(w, x)
                node >>= 1


def marks(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, bit o: the string that starts o bytes before the anchor is also one of a suffix of lower rank.

    Suffixes are in order, lcp is the prefix each shares with the one before;
    left holds the bytes before the anchor, nearest first; low to high are the
    o that each suffix stands for. A string is the same where the last
    length - o bytes and the o bytes before the anchor are: groups of the
    common prefixes on either side.
    """
    n = len(lcp)
    bits = np.zeros(n, np.uint64)
    if n < 2:
        return bits
    depth = left.shape[1]
    order = np.argsort(np.ascontiguousarray(left).view(f"S{depth}").ravel(), kind="stable")
    left_lcp = prefix_lengths(left[order])
    right_most = np.maximum(lcp, np.append(lcp[1:], 0))
    left_most = np.empty(n, np.int64)
    left_most[order] = np.maximum(left_lcp, np.append(left_lcp[1:], 0))
    # only those that share enough on both sides with any other can be repeated
    some = np.flatnonzero(right_most + left_most >= length)
    if not len(some):
        return bits
    low, high, rank_s = low[some], high[some], rank[some]
    right_most, left_most = right_most[some], left_most[some]
    left_group = np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        at = np.flatnonzero((low <= o) & (o <= high) & (right_most >= length - o) & (left_most >= o))
        if len(at) < 2:
            continue
        right_group = np.cumsum(lcp < length - o)
        left_group[order] = np.cumsum(left_lcp < o)
        key = right_group[some[at]] * (n + 1) + left_group[some[at]]
        by = np.argsort(key, kind="stable")
        k, r = key[by], rank_s[at][by]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(np.minimum.reduceat(r, start), np.diff(np.append(start, len(k))))
        bits[some[at[by[r > least]]]] |= np.uint64(1 << o)
    return bits


class Block:
    """A block's documents, one after the other, and its anchors; the same in every round."""

    def __init__(self, ids: list, texts: list[str | None], gone: set[int], length: int, k: int, hash_bits: int) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw, self.length, self.k = raw, length, k
        self.take = [i for i, r in enumerate(raw) if i not in gone and ids[i] is not None]
        self.bytes = np.frombuffer(b"".join(raw[i] for i in self.take), np.uint8)
        sizes = np.array([len(raw[i]) for i in self.take], np.int64)
        self.ends = np.cumsum(sizes)
        self.small = np.int32 if len(self.bytes) < 1 << 31 else np.int64  # one number a byte
        room = np.repeat(self.ends.astype(self.small), sizes)
        room -= np.arange(len(self.bytes), dtype=self.small)
        self.place, self.first, self.last, h = anchors(self.bytes, room, length, k)
        self.hash = _mixed(h) >> np.uint64(64 - hash_bits)
        rank, before = [], None
        for i in self.take:  # rows that share an id share a rank
            rank.append(rank[-1] + (ids[i] != before) if rank else 0)
            before = ids[i]
        self.rank = np.array(rank, np.int64)
        # strings that begin less than `near` bytes before the anchor have the first window, the others the second
        self.low, self.high = self.place - self.last, self.place - self.first
        self.near = (length - k) // 2 + 1
        window = min(length - self.near + 1, self.near + k) // 8 * 8
        first, second = self.low < self.near, self.high >= self.near
        keys = [window_hashes(self.bytes, self.place[first], window), window_hashes(self.bytes, self.place[second] + k - window, window) ^ _MIX]
        self.unique, which, self.times = np.unique(_mixed(np.concatenate(keys)) >> np.uint64(64 - hash_bits), return_inverse=True, return_counts=True)
        self.which = np.full((2, len(self.place)), -1, np.int32)  # of each anchor's windows
        self.which[0, first], self.which[1, second] = which[: len(keys[0])], which[len(keys[0]) :]

    def held(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchors, least o, greatest o) of the strings whose windows are `repeated`, one flag a distinct window."""
        first, second = np.append(repeated, False)[self.which]
        at = np.flatnonzero(first | second)
        low = np.where(first[at], self.low[at], np.maximum(self.low[at], self.near))
        high = np.where(second[at], self.high[at], np.minimum(self.high[at], self.near - 1))
        return at, low, high

    def suffixes(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of the anchors `at`: the bytes from the anchor, those before it (nearest first), and the o of the strings asked for; unneeded bytes are 0."""
        length, k = self.length, self.k
        a = self.place[at]
        out = np.zeros((len(at), length + length - k + 2), np.uint8)
        for s in range(0, len(at), 1 << 15):
            w = slice(s, s + (1 << 15))
            step = np.arange(length)
            right = np.minimum(a[w, None] + step, len(self.bytes) - 1)
            out[w, :length] = np.where(step < length - low[w, None], self.bytes[right], 0)
            step = np.arange(length - k)
            left = np.maximum(a[w, None] - 1 - step, 0)
            out[w, length : 2 * length - k] = np.where(step < high[w, None], self.bytes[left], 0)
        out[:, -2], out[:, -1] = low, high
        return out

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, self.place[at], side="right")


class Levels:
    """The tree of the exchange: `fan` branches a level, as many levels as `blocks` need, and a range of hashes for each leaf."""

    def __init__(self, blocks: int, fan: int, hash_bits: int) -> None:
        self.depth = 1
        while fan**self.depth < blocks:
            self.depth += 1
        self.fan = 1
        while self.fan**self.depth < blocks:
            self.fan += 1
        self.hash_bits = hash_bits

    def range_of(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The range of each hash at a level: ranges are of equal width, and hashes spread evenly."""
        n = self.fan**self.depth
        leaf = (keys.astype(np.float64) * (n / 2.0**self.hash_bits)).astype(np.int64).clip(0, n - 1)
        return leaf // self.fan ** (self.depth - level)

    def group_of(self, blocks: np.ndarray, level: int) -> np.ndarray:
        return blocks // self.fan**level


def _cuts(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(number, slice) of each run of equal numbers."""
    if len(numbers):
        start = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(numbers)], strict=True):
            yield int(numbers[a]), slice(a, b)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _messages(rows: list[tuple]) -> pa.Table:
    return _rows(rows, ["up", "part", "grp", "data"], [pa.bool_(), pa.int64(), pa.int64(), pa.binary()])


@contextlib.contextmanager
def _files_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of what is written go when that has been written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def merge_runs(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, prefix shared with the row before, block, index) of front-coded runs, merged; equal rows in order of their blocks."""
    decoded, numbers = [], []
    for x in data:
        x = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
        size = int.from_bytes(x[:8], "little")
        decoded.append(front_decode(x[8 : 8 + size], width))
        numbers.append(unpack_numbers(x[8 + size :], 2))
    strings = [[x.tobytes() for x in rows] for rows, _ in decoded]
    merged = list(LoserTree(strings, [lcp.tolist() for _, lcp in decoded]))
    run = np.array([x for x, _ in merged], np.int64)
    lcp = np.array([x for _, x in merged], np.int64)
    at = np.empty(len(run), np.int64)  # each string's place among all
    start = 0
    for i, (rows, _) in enumerate(decoded):
        at[run == i] = np.arange(start, start + len(rows))
        start += len(rows)
    rows = np.concatenate([rows for rows, _ in decoded])[at]
    block, index = (np.concatenate([x[k] for x in numbers])[at] for k in (0, 1))
    # runs come in no order: equal rows are put in that of their blocks
    same = np.cumsum(lcp < width)
    by = np.lexsort((block, same))
    return rows, lcp, block[by], index[by]


def coded_run(rows: np.ndarray, block: np.ndarray, index: np.ndarray) -> bytes:
    front = front_code(rows)
    run = len(front).to_bytes(8, "little") + front + pack_numbers(block, index)
    return len(run).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(run, asbytes=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 16, block_bytes: int = 8 << 20, fan: int = 1024, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the bytes that stay."""
    d = narrow(docs, id_col, text_col)
    spark = d.sparkSession
    id_type = d.schema["doc_id"].dataType.simpleString()
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    hash_bits = min(62, max(44, math.ceil(math.log2(total + 2)) + 14))
    levels = Levels(n_blocks, fan, hash_bits)
    depth, width = levels.depth, 2 * length - k + 2
    folders: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        folders.append(work_dir(spark))
        with _files_dropped(spark):
            return persisted(df, folders[-1])

    def dropped(*paths: str) -> None:
        """Deletes folders that nothing reads any more."""
        discard(spark, *paths)
        folders[:] = [x for x in folders if x not in paths]

    # blocks by ranges of the id, written once: every round reads a bucket's blocks without an exchange
    dealt = d.repartitionByRange(n_blocks, "doc_id").sortWithinPartitions("doc_id").select(
        F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        "doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
    )
    name = f"quern_blocks_{uuid.uuid4().hex}"
    folders.append(work_dir(spark))
    with _files_dropped(spark):
        dealt.write.bucketBy(n_blocks, "block").option("path", folders[-1]).option("compression", "zstd").saveAsTable(name)
    t = spark.table(name)

    # copies of a whole text in a document of a smaller id
    narrow_rows = t.where("doc_id IS NOT NULL").select("block", "row", "doc_id", "digest")
    # written, so that the join meets exchanges on both sides and a digest of many copies can be split
    least = written(narrow_rows.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "same"))
    copies = narrow_rows.join(least, F.col("digest") == F.col("same")).where("doc_id > least")
    copies = copies.select("block", F.lit(COPY).alias("kind"), F.col("row").alias("part"), F.lit(None).cast("binary").alias("data"))

    def block_of(left: pa.Table, mail: pa.Table) -> tuple[Block, int, list[bytes], list[bytes]]:
        left = left.sort_by("row")
        rows = left.column("row").to_pylist()
        kinds, parts, data = (mail.column(c).to_pylist() for c in ("kind", "part", "data"))
        gone = {x for kind, x in zip(kinds, parts, strict=True) if kind == COPY}
        repeated, earlier = ([x for kind, x in zip(kinds, data, strict=True) if kind == wanted] for wanted in (REPEATED, EARLIER))
        place = {r: i for i, r in enumerate(rows)}
        b = Block(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), {place[r] for r in gone if r in place}, length, k, hash_bits)
        return b, left.column("block")[0].as_py(), repeated, earlier

    def down(level: int, part: int, block: np.ndarray, *more: np.ndarray) -> list[tuple]:
        """Answers for blocks, to the groups of the level below."""
        by = np.lexsort((more[0], block))
        block, more = block[by], [x[by] for x in more]
        return [(False, part // levels.fan, g, pack_numbers(block[at], *[x[at] for x in more])) for g, at in _cuts(levels.group_of(block, level - 1))]

    def send_hashes(left: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            b, block, _, _ = block_of(left, mail)
            for part, at in _cuts(levels.range_of(b.unique, 1)):
                keys = b.unique[at].astype(np.int64)
                out.append((True, part, block // levels.fan, pack_numbers(keys, np.full(len(keys), block))))
        return _messages(out)

    def meet_hashes(level: int):
        """What two blocks of a group have is answered; each hash goes up once, with its least block."""

        def run(got: pa.Table) -> pa.Table:
            keys, blocks = (np.concatenate(x) for x in zip(*[unpack_numbers(x, 2) for x in got.column("data").to_pylist()], strict=True))
            by = np.lexsort((blocks, keys))
            keys, blocks = keys[by], blocks[by]
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            again = ~first | np.append(~first[1:], False)
            part, group = got.column("part")[0].as_py(), got.column("grp")[0].as_py()
            out = down(level, part, blocks[again], keys[again])
            if level < depth:
                keys, blocks = keys[first], blocks[first]
                out += [(True, p, group // levels.fan, pack_numbers(keys[at], blocks[at])) for p, at in _cuts(levels.range_of(keys, level + 1))]
            return _messages(out)

        return run

    def runs_of(b: Block, repeated: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(range, anchors, distinct rows in order, each anchor's row) of every first range that another block shares."""
        if not repeated:
            return
        keys = np.concatenate([unpack_numbers(x, 2)[1] for x in repeated]).astype(np.uint64)
        flag = np.isin(b.unique, keys)
        at, low, high = b.held(flag)
        ranges = levels.range_of(b.hash[at], 1)
        by = np.argsort(ranges, kind="stable")
        for r, own in _cuts(ranges[by]):
            own = by[own]
            rows = b.suffixes(at[own], low[own], high[own])
            own = at[own]
            distinct, row = np.unique(rows.view(f"S{width}").ravel(), return_inverse=True)
            yield r, own, np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, width), row

    def send_suffixes(left: pa.Table, mail: pa.Table) -> pa.Table:
        out, start = [], 0
        if left.num_rows:
            b, block, repeated, _ = block_of(left, mail)
            for r, _, rows, _ in runs_of(b, repeated):
                out.append((True, r, block // levels.fan, coded_run(rows, np.full(len(rows), block), np.arange(start, start + len(rows)))))
                start += len(rows)
        return _messages(out)

    def meet_suffixes(level: int):
        """Below the last level, rows that an earlier block of the group has whole are answered; the others go up. At the last, all are."""

        def run(got: pa.Table) -> pa.Table:
            rows, lcp, block, index = merge_runs(got.column("data").to_pylist(), width)
            low, high = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
            part, group = got.column("part")[0].as_py(), got.column("grp")[0].as_py()
            if level == depth:
                bits = marks(np.minimum(lcp, length), rows[:, length:-2], low, high, block, length)
                some = bits > 0
                return _messages(down(level, part, block[some], index[some], bits[some].view(np.int64)))
            again = lcp == width
            bits = (np.uint64(2) << high[again].astype(np.uint64)) - (np.uint64(1) << low[again].astype(np.uint64))
            out = down(level, part, block[again], index[again], bits.view(np.int64))
            rows, block, index = rows[~again], block[~again], index[~again]
            h = _mixed(kmer_hashes(np.ascontiguousarray(rows[:, :k]).ravel(), k)[::k]) >> np.uint64(64 - hash_bits)
            narrower = levels.range_of(h, level + 1)
            by = np.argsort(narrower, kind="stable")  # rows stay in order within a range
            for p, at in _cuts(narrower[by]):
                at = by[at]
                out.append((True, p, group // levels.fan, coded_run(rows[at], block[at], index[at])))
            return _messages(out)

        return run

    def pass_down(level: int, columns: int):
        def run(got: pa.Table) -> pa.Table:
            cols = [np.concatenate(x) for x in zip(*[unpack_numbers(x, columns) for x in got.column("data").to_pylist()], strict=True)]
            return _messages(down(level, got.column("part")[0].as_py(), *cols))

        return run

    def finish(left: pa.Table, mail: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _result([])
        b, _, repeated, earlier = block_of(left, mail)
        start = np.zeros(len(b.bytes) + 1, bool)

        def remove(at: np.ndarray, bits: np.ndarray) -> None:
            for o in range(length - k + 1):
                hit = (bits >> np.uint64(o)) & np.uint64(1) > 0
                start[b.place[at[hit]] - o] = True

        if earlier:
            parts = [unpack_numbers(x, 3) for x in earlier]
            index, bits = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]).view(np.uint64)
            anchor, row, n = [], [], 0
            for _, own, rows, which in runs_of(b, repeated):
                anchor.append(own)
                row.append(which + n)
                n += len(rows)
            of_row = np.zeros(n, np.uint64)
            np.bitwise_or.at(of_row, index, bits)
            remove(np.concatenate(anchor), of_row[np.concatenate(row)])
        # what an earlier document of the block has
        at, low, high = b.held(b.times > 1)
        if len(at):
            rows = b.suffixes(at, low, high)
            by = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
            at, rows = at[by], rows[by]
            lcp = np.minimum(prefix_lengths(rows[:, :length]), length)
            remove(at, marks(lcp, rows[:, length:-2], rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64), b.rank[b.document(at)], length))
        n = len(b.bytes)
        count = np.zeros(n + 1, b.small)
        np.cumsum(start[:-1], out=count[1:])
        covered = count[1:] > 0  # a string starts at the byte or up to length - 1 before it
        covered[length - 1 :] = count[length:] > count[: max(n - length + 1, 0)]
        ids = left.sort_by("row").column("doc_id").to_pylist()
        out, own = [], {i: j for j, i in enumerate(b.take)}
        for i, raw in enumerate(b.raw):
            if i in own:
                lo, hi = (int(b.ends[own[i] - 1]) if own[i] else 0), int(b.ends[own[i]])
                c = covered[lo:hi]
                kept = b.bytes[lo:hi][~c].tobytes() if c.any() else raw
                spans = int(c[:1].sum()) + int((c[1:] & ~c[:-1]).sum())
            else:  # a copy; without an id nothing goes
                whole = ids[i] is not None and len(raw) >= length
                kept, spans = (b"", 1) if whole else (raw, 0)
            out.append((ids[i], len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return _result(out)

    id_arrow = d.limit(0).toArrow().schema.field("doc_id").type

    def _result(rows: list[tuple]) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        return _rows(rows, names, [id_arrow, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)])

    def rounds(mail: DataFrame, fn, schema: str) -> DataFrame:
        blocks = spark.table(name).select("block", "row", "doc_id", "text")
        mail = mail.select(F.col("block").alias("block"), *[F.col(c).alias(c) for c in ("kind", "part", "data")])
        return blocks.groupBy("block").cogroup(mail.groupBy("block")).applyInArrow(fn, schema)

    def exchange(sent: DataFrame, meet, columns: int, kind: int) -> DataFrame:
        """Messages up through the levels and the answers back to their blocks; what a level makes is written, so that no round runs twice."""
        answers, before = [], ""
        for level in range(1, depth + 1):
            made = written(sent.groupBy("part", "grp").applyInArrow(meet(level), _MESSAGE))
            own = folders[-1]
            if level > 1:  # what went up to this level has been read
                answers[-1] = written(answers[-1])
                dropped(before)
            before = own
            sent = made.where("up")
            answers.append(made.where("NOT up"))
        back = answers[-1]
        for level in range(depth - 1, 0, -1):
            back = back.groupBy("part", "grp").applyInArrow(pass_down(level, columns), _MESSAGE).unionByName(answers[level - 1])
        return back.select(F.col("grp").cast("int").alias("block"), F.lit(kind).alias("kind"), "part", "data")

    copies = written(copies)
    made = len(folders)
    repeated = exchange(rounds(copies, send_hashes, _MESSAGE), meet_hashes, 2, REPEATED)
    if depth > 1:
        read = len(folders)
        repeated = written(repeated)
        dropped(*folders[made:read])
    mail = copies.unionByName(repeated)
    earlier = exchange(rounds(mail, send_suffixes, _MESSAGE), meet_suffixes, 3, EARLIER)
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    with _files_dropped(spark):
        result = persisted(rounds(mail.unionByName(earlier), finish, schema))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(spark, *folders)
    return result
