"""Benchmark decontamination with the q-gram lemma.

A document leaks a benchmark item when some region of it is within the item's
edit budget (``ERROR`` of its length).  If so, region and item share at least
``m - q + 1 - k q`` q-grams whose diagonals differ by at most 2k.  Every q-gram
of a text is looked up in the items' grams, hits are counted in overlapping
bands of diagonals, bands that meet the bound stay, and a banded alignment
decides them.  q is 8, or for units under 40 bytes the largest value (5 to 8)
that leaves a shared gram at the full budget; units of one q share a table.

Texts are compared by their letters and digits only, in lower case, so blanks,
line breaks and punctuation of any script never matter.  Items are cut into overlapping
units of at most ``UNIT`` bytes, so a long part of a long item is found too.

The items reach the tasks in closures of at most ``GROUP_BYTES``; a larger
benchmark is matched group by group, each group against all documents.

Defined cases: null texts and items count as empty and an empty item or table
reports nothing; an item of fewer than 8 bytes of letters and digits is reported
where a whole line of a document is that item (inside a line so short a word
proves nothing); repeated items report the same regions once per item id;
repeated documents are matched one by one; rows with a null document or item id
are matched and keep the null; very long texts are looked at in overlapping
pieces; of equally good regions one is reported, as only the edits are; other
columns of the documents are never read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import table, text_or_empty

Q, ERROR, UNIT = 8, 0.1, 256
BAND = 64              # counted cells; a band is two neighbouring cells
PIECE = 1 << 17        # bytes of text looked at together
HITS = 1 << 20         # gram hits counted at once; the rest of a piece follows in parts
GROUP_BYTES = 4 << 20  # items matched in one pass; their table takes about 20 times as much
_MULT = np.uint64(0x9E3779B97F4A7C15)
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_MARKS = re.compile(r"[^\w\x00-\x7f]+")
_MAX_K = int(ERROR * UNIT)
_GAP = bytes(2 * BAND + 2 * _MAX_K)  # as wide as an aligned band: each region lies in one document
_OVERLAP = 2 * UNIT + 2 * BAND


def normal(text: str | None) -> bytes:
    low = (text or "").lower()
    return (low if low.isascii() else _MARKS.sub("", low)).encode().translate(None, _DROP)


def budget(m: int) -> int:
    """Edits allowed in a unit of m bytes."""
    return int(ERROR * m)


def gram_length(m: int) -> int:
    """Longest gram of which a unit of m bytes keeps one at its full budget."""
    return min(Q, m // (budget(m) + 1))


def units(items: list[tuple[int | None, str | None]]) -> list[tuple[int | None, bytes]]:
    out = []
    for item_id, text in items:
        b = normal(text)
        if len(b) < Q:
            continue
        n = 1 if len(b) <= UNIT else 1 + -(-(len(b) - UNIT) // (UNIT // 2))
        for k in range(n):
            at = 0 if n == 1 else round(k * (len(b) - UNIT) / (n - 1))
            out.append((item_id, b[at:at + UNIT]))
    return out


class _Table:
    """Grams of the units of a group with one gram length, by slot of a multiplicative hash."""

    def __init__(self, rows: list[tuple[int | None, bytes]], q: int):
        self.rows, self.q = rows, q
        self.size = np.array([len(b) for _, b in rows], np.int64)
        self.k = np.array([budget(m) for m in self.size], np.int64)
        self.least = self.size - q + 1 - self.k * q
        code = np.concatenate([_grams(np.frombuffer(b, np.uint8), q) for _, b in rows])
        unit = np.repeat(np.arange(len(rows), dtype=np.int32), self.size - q + 1)
        pos = np.concatenate([np.arange(m - q + 1, dtype=np.int16) for m in self.size])
        self.bits = max(16, int(2 * len(code)).bit_length())
        slot = self.slot(code)
        order = np.argsort(slot, kind="stable")
        self.code, self.unit, self.pos = code[order], unit[order], pos[order]
        self.count = np.bincount(slot, minlength=1 << self.bits).astype(np.int32)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def bands(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, first diagonal of the band + UNIT) of the bands that meet the bound.

        Hits are counted per (unit, cell of diagonals) in parts of about ``HITS``."""
        code = _grams(text, self.q)
        slot = self.slot(code)
        at = np.flatnonzero(self.count[slot])
        n = self.count[slot[at]].astype(np.int64)
        cells = (len(text) + UNIT) // BAND + 2
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stop = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS), side="right")
        for a, b in zip([0, *stop[:-1].tolist()], [*stop[:-1].tolist(), len(at)]):
            gram = np.repeat(self.start[slot[at[a:b]]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(n[a:b].sum())
            where = np.repeat(at[a:b], n[a:b])
            same = self.code[gram] == code[where]
            gram, where = gram[same], where[same]
            key, count = np.unique(self.unit[gram] * np.int64(cells) + (where - self.pos[gram] + UNIT) // BAND,
                                   return_counts=True)
            keys.append(key)
            sums.append(count)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(sums), len(key)).astype(np.int64)
        if not len(key):
            return key, key
        # a band is a cell and the one after it; either may be empty
        band = np.unique(np.concatenate([key, key[key % cells > 0] - 1]))

        def of(wanted):
            i = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[i] == wanted, count[i], 0)

        both = of(band) + np.where((band + 1) % cells > 0, of(band + 1), 0)
        band = band[both >= self.least[band // cells]]
        return band // cells, band % cells * BAND

    def align(self, text: np.ndarray, unit: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each unit inside its band, and where that region ends.

        One column per diagonal, one row per byte of the unit, all regions side by side."""
        width = 2 * BAND + 2 * _MAX_K
        base = diagonal - UNIT - _MAX_K
        longest = int(self.size[unit].max())
        col = np.arange(width)
        pad = np.concatenate([text, np.zeros(1, np.uint8)])
        letters = np.zeros((len(unit), longest), np.uint8)
        for i, u in enumerate(unit):
            letters[i, :self.size[u]] = np.frombuffer(self.rows[u][1], np.uint8)
        d = np.zeros((len(unit), width), np.int32)
        edits, end = np.full(len(unit), 1 << 20), np.zeros(len(unit), np.int64)
        for r in range(longest):
            at = base[:, None] + r + col
            at = np.where((at < 0) | (at >= len(text)), len(text), at)
            new = d + (pad[at] != letters[:, r:r + 1])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            new = np.minimum.accumulate(new - col, axis=1) + col
            d = new
            done = np.flatnonzero(self.size[unit] == r + 1)
            if len(done):
                c = d[done].argmin(1)
                edits[done] = d[done, c]
                end[done] = base[done] + r + c
        return edits, end


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    n = max(len(data) - q + 1, 0)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])  # eight bytes are read from every start
    return np.ndarray((n,), "<u8", wide, 0, (1,)) & np.uint64((1 << 8 * q) - 1)


class Matcher:
    def __init__(self, items: list[tuple[int | None, str | None]]):
        rows = units(items)
        of_length = {q: [r for r in rows if gram_length(len(r[1])) == q] for q in range(1, Q + 1)}
        self.tables = [_Table(r, q) for q, r in of_length.items() if r]
        self.lines: dict[bytes, list[int | None]] = {}
        for item_id, text in items:
            if 0 < len(b := normal(text)) < Q:
                self.lines.setdefault(b, []).append(item_id)

    def find(self, texts: list[str | None]) -> list[tuple[int, int | None, int]]:
        """(index of the text, item id, edits) once per leaking text and item."""
        best: dict[tuple[int, int | None], int] = {}
        held, owner, size = [], [], 0
        for k, text in enumerate(texts):
            b = normal(text)
            if self.lines:
                for line in (text or "").split("\n"):
                    best.update(((k, item), 0) for item in self.lines.get(normal(line), ()))
            for at in range(0, max(len(b) - _OVERLAP, 1), PIECE):
                part = b[at:at + PIECE + _OVERLAP]
                if len(part) >= Q:
                    held.append(part)
                    owner.append(k)
                    size += len(part)
                if size >= PIECE:
                    self._look(held, owner, best)
                    held, owner, size = [], [], 0
        self._look(held, owner, best)
        return [(k, item, e) for (k, item), e in best.items()]

    def _look(self, parts: list[bytes], owner: list[int], best: dict) -> None:
        if not parts:
            return
        text = np.frombuffer(_GAP.join(parts), np.uint8)
        stop = np.cumsum([len(p) + len(_GAP) for p in parts])
        for table in self.tables:
            unit, diagonal = table.bands(text)
            for a in range(0, len(unit), 2048):
                u = unit[a:a + 2048]
                edits, end = table.align(text, u, diagonal[a:a + 2048])
                for i in np.flatnonzero(edits <= table.k[u]):
                    k = owner[min(int(np.searchsorted(stop, end[i], side="right")), len(owner) - 1)]
                    key = (k, table.rows[u[i]][0])
                    best[key] = min(best.get(key, 1 << 20), int(edits[i]))


def item_groups(benchmark: DataFrame) -> list[list[tuple[int | None, str | None]]]:
    """The items in lists of about GROUP_BYTES; one list unless the benchmark is large."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // GROUP_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sorted(((r[0], r[1]) for r in rows.filter(part == k).collect()), key=str) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits: one row per leaking input row and item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def found(items):
        def run(batches):
            matcher = Matcher(items)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = sorted(matcher.find(batch.column(1).to_pylist()), key=str)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k, _, _ in hits], pa.int64()), pa.array([i for _, i, _ in hits], pa.int64()),
                     pa.array([e for *_, e in hits], pa.int64())], names=["doc_id", "item_id", "edits"])

        return rows.mapInArrow(run, "doc_id long, item_id long, edits long")

    return reduce(DataFrame.unionByName, [found(g) for g in item_groups(benchmark)])


def leaking(items: list[tuple[int | None, str | None]]):
    """Pandas UDF text -> does it leak any of the items."""
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items)
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            hit[[k for k, _, _ in matcher.find(texts.fillna("").tolist())]] = True
            yield pd.Series(hit)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    for items in item_groups(benchmark):
        docs = docs.filter(~leaking(items)(text_or_empty(text_col)))
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
