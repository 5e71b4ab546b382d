"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A text is cut by the tokenizer's pattern; each piece that is not a token itself
is merged in order of rank, the leftmost first among equal ranks.  The pending
merges of a piece are buckets of positions, one per rank, and a two-level bitmap
of the ranks in use: find-first-set on the summary and on one word gives the
least rank.  Tokens are a linked list over the piece's bytes; an entry whose
position has another merge by now is stale and is skipped.  A merge costs two
look-ups and two pushes whatever the piece's length, so a piece of n bytes takes
O(n log n) and about 20 bytes of memory a byte.

The file of ranks is a parameter and is read where Python runs.  Pieces seen
before are looked up in a bounded table; rows are encoded one by one.

Defined cases: a null text is an empty one (no ids, empty bytes) and null ids
decode to null; empty tables give empty tables; rows repeat as they are given;
columns that are not read are kept under their names, and a result column whose
name is taken (in any case) replaces that column; texts and pieces of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import table, text_or_empty

PIECES, PIECE_BYTES = 1_000_000, 64  # pieces remembered per Python worker, and the longest of them
_WORD = 8                          # log2 of the ranks a word of the bitmap stands for
_BIT = [1 << i for i in range(1 << 12)]  # up to 2^20 ranks
_LONG = 4096                       # bytes; longer pieces keep their positions in arrays


def _tables(ranks: dict[bytes, int]) -> list[list[int]]:
    """[a][b]: rank of two bytes (-1: no token); at 256 the ranks of single bytes, at 257 an empty bitmap."""
    two = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
    return [*two, [ranks[bytes((a,))] for a in range(256)], [0] * ((max(ranks.values()) >> _WORD) + 1)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int]]) -> list[int]:
    """Ids of a piece by merging, least rank first, then leftmost; ``pairs``: see ``_tables``."""
    n = len(piece)
    get, low = ranks.get, (1 << _WORD) - 1
    many = (lambda xs: array("i", xs)) if n > _LONG else list
    after, before = many(range(1, n + 1)), many(range(-1, n - 1))
    pending = many(pairs[a][b] for a, b in zip(piece, piece[1:]))
    pending.append(-1)
    ids = many(map(pairs[256].__getitem__, piece))
    waiting: dict[int, list | array] = {}  # rank -> positions, not yet in order
    opened: dict[int, list] = {}           # rank -> [positions in order, next one, heap of later positions]
    words = pairs[257][:]                  # all zero
    summary = 0
    for p, r in enumerate(pending):
        if r >= 0:
            if r in waiting:
                waiting[r].append(p)
            else:
                waiting[r] = many((p,))
                words[r >> _WORD] |= _BIT[r & low]
                summary |= _BIT[r >> _WORD]
    while summary:
        at = (summary & -summary).bit_length() - 1
        bit = words[at]
        bit &= -bit
        rank = (at << _WORD) + bit.bit_length() - 1
        if rank in opened:
            ready, k, late = opened.pop(rank)
        else:
            ready, k, late = waiting.pop(rank), 0, []
            if len(ready) > 1:
                if n > _LONG:
                    np.frombuffer(ready, np.int32).sort()
                else:
                    ready.sort()
        end = len(ready)
        while True:
            if late and (k == end or late[0] < ready[k]):
                p = heappop(late)
            elif k < end:
                p = ready[k]
                k += 1
            else:  # the bucket is empty
                words[at] ^= bit
                if not words[at]:
                    summary ^= _BIT[at]
                break
            if pending[p] != rank:
                continue  # stale
            q = after[p]
            after[p] = e = after[q]
            pending[q] = pending[p] = -1
            ids[p] = rank
            found = ()
            if e < n:
                before[e] = p
                r = get(piece[p:after[e]])
                if r is not None:
                    pending[p] = r
                    found = ((r, p),)
            q = before[p]
            if q >= 0:
                r = get(piece[q:e])
                if r is None:
                    pending[q] = -1
                else:
                    pending[q] = r
                    found += ((r, q),)
            least = rank
            for r, q in found:
                if r in waiting:
                    waiting[r].append(q)
                elif r == rank:
                    heappush(late, q)
                elif r in opened:
                    heappush(opened[r][2], q)
                else:
                    waiting[r] = many((q,))
                    words[r >> _WORD] |= _BIT[r & low]
                    summary |= _BIT[r >> _WORD]
                if r < least:
                    least = r
            if least < rank:  # a lower rank goes first; this bucket goes on afterwards
                opened[rank] = [ready, k, late]
                break
    out, p = [], 0
    while p < n:
        out.append(ids[p])
        p = after[p]
    return out


class _Pieces(dict):
    """piece -> its ids; takes no more when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, _tables(ranks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(merge(data, self.ranks, self.pairs))
        if len(data) <= PIECE_BYTES and len(self) < PIECES:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of a file of ranks (base64 of a token's bytes, blank, rank, a line)."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        self.pieces, self.cut = _Pieces(self.ranks), regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}

    def encode(self, text: str) -> list[int]:
        found = (m.group() for m in self.cut.finditer(text)) if len(text) > 1 << 20 else self.cut.findall(text)
        return list(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a worker; files are opened where this is called."""
    return _codec(path or default_path(), pattern or default_pattern())


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None,
                     pattern: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text (array<int>)."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series([np.array(c.encode(t), np.int32) for t in texts], dtype=object)

    return docs.withColumn(out, run(text_or_empty(f"`{text_col}`")))


def decode_documents(rows: DataFrame, ids_col: str = "ids", path: str | None = None,
                     pattern: str | None = None, out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``: the bytes (binary) that the ids stand for; an unknown id raises."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for found in batches:
            yield pd.Series([None if ids is None else c.decode(ids.tolist()) for ids in found], dtype=object)

    return rows.withColumn(out, run(F.col(f"`{ids_col}`")))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec()
        for texts in batches:
            rows = []
            for text in texts:
                ids = c.encode(text)
                line = ",".join(map(c.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(),
                             hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, sf_dir, "documents").select("doc_id", digests(text_or_empty()).alias("r")).select("doc_id", "r.*")
