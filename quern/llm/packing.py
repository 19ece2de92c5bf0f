"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs `linear * n + quadratic * n * n`: the linear layers
and the attention within the piece. Documents are cut into whole sequences
and a rest; the rests of a block, in descending cost, go to the sequence of
lowest cost that still has room. One without enough room anywhere is cut to
fill the cheapest sequence with room. A block has exactly as many sequences
as its tokens need; the last one's capacity is split into powers of two, so
that nothing is padded.

A task tokenises and packs its own partition, block by block: no exchange,
memory bounded by `block_docs` rests, and a hot source or one very long text
changes nothing. Sequence ids are the partition's number and a counter.

Ids are those of `tokenizers` with add_special_tokens=False: a special token's
string in a text becomes that token, as it does there; `plain_specials` makes
such strings ordinary text.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.common import map_arrow, narrow

_LONG = 1 << 18
#: A place where the pre-tokeniser always cuts: before a space between two ASCII letters.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def tokenizer(path: str, plain_specials: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if plain_specials:
        t.encode_special_tokens = True
    return t


def _parts(text: str) -> list[str]:
    """Very long texts in parts that tokenise as the whole does, by a pre-tokeniser that always cuts at `_SAFE`."""
    if len(text) <= _LONG:
        return [text]
    out, at = [], 0
    while len(text) - at > _LONG:
        m = _SAFE.search(text, at + _LONG)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


#: The pre-tokeniser of byte-level BPE vocabularies of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = ("it's  a\n\n b\tc 12 3.5%% don't WE'LL\r\n x\u00a0y ", " \u00e9t\u00e9 \u65e5\u672c\u8a9e \U0001f600 <|endoftext|> \u00bd\n", "The anenthering thble oftion")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for the bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids of the tokenizer in `path`.

    Where the file is a byte-level BPE whose ids are its ranks, the same merges
    are run by a rank-table encoder, which gives the same ids several times
    faster; a probe decides, and any other file is encoded by tokenizers.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        self.tokenizer = tokenizer(path, plain_specials)
        self.fast: Callable[[str], list[int]] | None = None
        alphabet = _byte_alphabet()
        added = self.tokenizer.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items()}
        words = {w: i for w, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if w not in special}
        # a special token that takes white space along or whole words alone, or that a cut could part, is left to tokenizers
        plain = all(not (t.lstrip or t.rstrip or t.single_word or _SAFE.search(t.content)) for t in added.values())
        if plain and all(c in alphabet for w in words for c in w):
            import tiktoken

            ranks = {bytes(alphabet[c] for c in w): i for w, i in words.items()}
            try:
                table = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={} if plain_specials else special)
                fast = table.encode_ordinary if plain_specials else partial(table.encode, allowed_special="all", disallowed_special=())
                probes = [*_PROBE, *(f"a {s}  b\n{s}{s}" for s in special)]
                if all(fast(t) == self._slow(t) for t in probes):
                    self.fast, self.tokenizer = fast, None
            except (KeyError, ValueError):
                pass

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None, end_id: int = 0) -> np.ndarray:
        """A text's ids and the end id, as little-endian unsigned 32-bit."""
        if not text:
            ids = []
        elif self.fast is None:
            ids = self._slow(text)
        else:
            ids = [i for p in _parts(text) for i in self.fast(p)]
        ids.append(end_id)
        return np.frombuffer(array("I", ids), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    return Encoder(path, plain_specials)


def pack_block(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for rests of 1 to size - 1 tokens.

    Room is looked up by remaining capacity: a heap of sequences by cost for
    each capacity, and the cheapest of each in an array.
    """
    total = sum(lengths)
    rooms = [size] * (total // size) + [1 << k for k in range(size.bit_length(), -1, -1) if (total % size) >> k & 1]
    free: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
    for s, room in enumerate(rooms):
        free[room].append((0.0, s))
    best = np.full(size + 1, np.inf)
    for room in set(rooms):
        heapq.heapify(free[room])
        best[room] = free[room][0][0]
    out = []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[doc]
        while rest:
            room = rest + int(np.argmin(best[rest:]))
            if best[room] == np.inf:
                room = int(np.argmin(best))  # none has enough: fill the cheapest with any room
            cost, s = heapq.heappop(free[room])
            best[room] = free[room][0][0] if free[room] else np.inf
            n = min(rest, room)
            out.append((doc, start, n, s, rooms[s] - room))
            if room > n:
                cost += linear * n + quadratic * n * n
                heapq.heappush(free[room - n], (cost, s))
                best[room - n] = free[room - n][0][0]
            start, rest = start + n, rest - n
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 2048, block_docs: int = 2048, with_ids: bool = False, plain_specials: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    d = narrow(docs, id_col, text_col)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        encode = encoder(tokenizer_path, plain_specials).encode
        seq = 0
        rests: list[tuple[int, int, np.ndarray]] = []  # document, its ids before the rest, the rest's ids
        rows: list[list] = [[] for _ in range(8)]
        id_type = None

        def put(doc, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
            for col, v in zip(rows, (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base + sequence, offset, ids.astype(np.int32) if with_ids else None), strict=True):
                col.append(v)

        def close() -> None:
            nonlocal seq
            used = seq
            for i, start, n, s, offset in pack_block([len(x[2]) for x in rests], size, linear, quadratic):
                doc, before, ids = rests[i]
                put(doc, before + start, ids[start : start + n], before + len(ids), seq + s, offset)
                used = max(used, seq + s + 1)
            seq = used
            rests.clear()

        def batch_out() -> pa.RecordBatch:
            cols = [pa.array(rows[0], id_type), *[pa.array(c, pa.int64()) for c in rows[1:7]]]
            if with_ids:
                cols.append(pa.array(rows[7], pa.list_(pa.int32())))
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text, end_id)
                    whole = len(ids) // size
                    for k in range(whole):
                        put(doc, k * size, ids[k * size : (k + 1) * size], len(ids), seq, 0)
                        seq += 1
                    if len(ids) % size:
                        rests.append((doc, whole * size, ids[whole * size :].copy()))
                    if len(rests) >= block_docs:
                        close()
                    if len(rows[0]) >= 1024:
                        yield batch_out()
        close()
        if rows[0]:
            yield batch_out()

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` long" for n in names[1:]) + ", ids array<int>" * with_ids
    return map_arrow(d, run, schema)
