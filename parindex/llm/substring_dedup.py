"""Substring dedup by difference-cover anchors.

A passage of ``WINDOW`` words that starts in a document with a smaller id is
removed wherever it comes back.  Anchors are the hashes of ``WINDOW - PERIOD +
1`` words at the positions whose remainder modulo ``PERIOD`` is in a difference
cover: for any two positions some shift below the period brings both onto the
cover, so two equal windows always hold a pair of equal, aligned anchors.
Only 6 of 31 positions are hashed and shuffled in this first step.

An anchor that two documents share is then extended: all windows that hold it
are hashed whole (80 bits), grouped, and compared with the least document that
has them; hashes are grouped with partial minima before the shuffle, so a
passage in a third of all documents is one row per task.  Windows that hold
more than 1/``SHARE`` of all rows (fewer than ``SHARE`` by counting) are broadcast
with their least document, so their rows are not shuffled at all.

Shared anchors are told to the second pass over the texts as a bit filter of at
most ``FILTER_BITS`` bits (false positives only cost work); beyond that size
they are joined to the anchors instead.  Whole copies are dropped early where
the table of copied texts is small (``COPIES``); they would be found anyway.

Defined cases: a null text has no words; documents with a null id neither lose
nor cause anything; rows that agree in id and text get the same result and all
are returned; rows with equal ids do not remove each other's windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import cut, table, text_or_empty, written

WINDOW, PERIOD = 50, 31
#: fixed values: a perfect difference set modulo 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
FILTER_BITS = 1 << 27
COPIES = 200_000
SHARE = 1024


class Words:
    """The words of a text, joined by one space, with their ends."""

    def __init__(self, text: str | bytes):
        words = (text.encode() if isinstance(text, str) else text).split()
        self.n = len(words)
        self.joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, self.n)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def slices(self, at: np.ndarray, k: int):
        view = memoryview(self.joined)
        return [view[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at + k - 1].tolist())]

    def text_hash(self) -> tuple[int, int]:
        return tuple(np.frombuffer(xxhash.xxh3_128_digest(self.joined), "<i8").tolist())

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover and the hashes there; none in a text without a window."""
        if self.n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(self.n - ANCHOR + 1)
        at = at[_ON_COVER[at % PERIOD]]
        return at, np.array([xxhash.xxh3_64_intdigest(s) for s in self.slices(at, ANCHOR)], np.uint64)

    def windows_with(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of ``at``."""
        mark = np.zeros(self.n + 2, np.int64)
        np.add.at(mark, np.maximum(at - (PERIOD - 1), 0), 1)
        np.add.at(mark, at + 1, -1)
        return np.flatnonzero(np.cumsum(mark)[:self.n - WINDOW + 1] > 0)

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in self.slices(at, WINDOW)),
                              "<i8").reshape(-1, 2)
        return found[:, 0], (found[:, 1] & 0x7FFF).astype(np.int16)

    def kept(self, starts: np.ndarray) -> tuple[int, bytes]:
        """Words covered by the windows at ``starts``, and the other words joined."""
        mark = np.zeros(self.n + WINDOW + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + WINDOW, -1)
        stays = np.flatnonzero(np.cumsum(mark)[:self.n] == 0)
        return self.n - len(stays), b" ".join(self.slices(stays, 1))


_ON_COVER = np.zeros(PERIOD, bool)
_ON_COVER[list(COVER)] = True


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def anchor_hashes(rows: DataFrame) -> DataFrame:
    """The distinct anchor hashes of every text, nothing else."""
    def run(batches):
        for batch in batches:
            held, n = [], 0
            for text in batch.column(0).to_pylist():
                held.append(np.unique(Words(text).anchors()[1]))
                n += len(held[-1])
                if n > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["h"])
                    held, n = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["h"])

    return rows.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "h long")


def anchors(rows: DataFrame) -> DataFrame:
    """hash, doc_id, pos and the text's hash of every anchor."""
    def flush(held):
        h, doc, pos, t1 = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(t1)],
                                          names=["h", "doc_id", "pos", "t1"])

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = Words(text)
                at, h = w.anchors()
                if len(at):
                    held.append((h, np.full(len(at), doc_id, np.int64), at.astype(np.int32),
                                 np.full(len(at), w.text_hash()[0], np.int64)))
                    n += len(at)
                if n > 50_000:
                    yield flush(held)
                    held, n = [], 0
            if held:
                yield flush(held)

    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, "h long, doc_id long, pos int, t1 long")


def copied_texts(rows: DataFrame) -> dict[tuple[int, int], int] | None:
    """Text hash -> least id for texts of several documents; None if there are too many."""
    def run(batches):
        for batch in batches:
            found = [Words(t).text_hash() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "t1", "t2"])

    found = cut(rows.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, t1 long, t2 long")
                .groupBy("t1", "t2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"))
                .filter("m < x").drop("x"))
    if found.count() > COPIES:
        return None
    return {(r[0], r[1]): r[2] for r in found.collect()}


def bit_filter(shared: DataFrame, n: int) -> np.ndarray:
    """Bits of the shared hashes: at least 16 a hash, two probes each."""
    k = max(12, int(np.ceil(np.log2(max(n, 1) * 16))))
    k = min(k, int(np.log2(FILTER_BITS)))
    one = F.shiftrightunsigned("h", 64 - k)
    two = F.shiftrightunsigned("h", 32 - min(k, 31)).bitwiseAND(F.lit((1 << k) - 1))
    bits = shared.select(F.explode(F.array(one, two)).alias("p"))
    cells = (bits.groupBy(F.shiftright("p", 6).alias("cell"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("v")).toPandas())
    out = np.zeros(1 << (k - 6), np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["v"].to_numpy(np.int64)
    return out


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = np.uint64(int(np.log2(len(bits))) + 6)
    view = bits.view(np.uint64)

    def has(p):
        return (view[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0

    one = h >> (np.uint64(64) - k)
    two = (h >> np.uint64(32 - min(int(k), 31))) & np.uint64((1 << int(k)) - 1)
    return has(one) & has(two)


_SCAN = ("doc_id long, t1 long, n_words long, n_removed long, kept_sha256 string, text binary, "
         "starts array<int>, w array<long>, c array<short>")


def _scan(copies, bits):
    """Pass 2: candidate windows of every text, and the answer of texts without any.

    With ``bits`` the anchors are looked up in the filter; otherwise the input
    has a third column with the positions of the shared anchors."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            given = batch.column(2).to_pylist() if bits is None else None
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                w = Words(text)
                t1, t2 = w.text_hash()
                least = copies.get((t1, t2)) if copies and doc_id is not None else None
                if least is not None and least < doc_id and w.n >= WINDOW:
                    out.append((doc_id, t1, w.n, w.n, hashlib.sha256(b"").hexdigest(), None, None, None, None))
                    continue
                starts = np.zeros(0, np.int64)
                if doc_id is not None and w.n >= WINDOW:
                    if bits is not None:
                        at, h = w.anchors()
                        at = at[probe(bits.value, h)]
                    else:
                        at = np.array(given[k] or [], np.int64)
                    if len(at):
                        starts = w.windows_with(at)
                sha = hashlib.sha256(w.joined).hexdigest()
                if len(starts):
                    h, c = w.window_hashes(starts)
                    out.append((doc_id, t1, w.n, 0, sha, press.compress(w.joined), starts.astype(np.int32), h, c))
                else:
                    out.append((doc_id, t1, w.n, 0, sha, None, None, None, None))
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                                pa.list_(pa.int16())]
    names = [x.split()[0] for x in _SCAN.split(", ")]
    cols = list(zip(*out)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _finish(batches):
    """Removes the repeated windows of the texts that have some."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(6)]
        out = []
        for doc_id, n, removed, sha, text, dup in zip(*cols):
            if dup:
                removed, kept = Words(press.decompress(text)).kept(np.unique(np.array(dup, np.int64)))
                sha = hashlib.sha256(kept).hexdigest()
            out.append((doc_id, n, removed, sha))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            cols, [pa.int64()] * 3 + [pa.string()])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def frequent_windows(windows: DataFrame) -> DataFrame:
    """w, c, m (least doc_id) of the windows with more than 1/SHARE of all rows.

    Rows are counted by a coarse part of the hash first; only the parts that can
    hold such a window are counted window by window."""
    part = F.pmod("w", F.lit(4 * SHARE))
    counts = {r[0]: r[1] for r in windows.groupBy(part.alias("p")).count().collect()}
    total = sum(counts.values())
    parts = [p for p, n in counts.items() if n * SHARE > total]
    return cut(windows.filter(part.isin(parts)).groupBy("w", "c")
               .agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") * SHARE > total).drop("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   filter_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    filter_bits = FILTER_BITS if filter_bits is None else filter_bits
    rows = _rows(docs, id_col, text_col)
    spark = rows.sparkSession
    shared = cut(anchor_hashes(rows).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select("h"))
    n = shared.count()
    copies = copied_texts(rows)
    if n * 4 <= filter_bits:
        bits = spark.sparkContext.broadcast(bit_filter(shared, n))
        scanned = rows.mapInArrow(_scan(copies, bits), _SCAN)
    else:
        where = (anchors(rows).join(shared, "h", "left_semi").groupBy("doc_id", "t1")
                 .agg(F.collect_set("pos").alias("at")).select(F.col("doc_id").alias("d"), "t1", "at"))

        def hashed(batches):
            for batch in batches:
                t1 = [Words(t).text_hash()[0] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t1, pa.int64())],
                                                 names=["doc_id", "text", "t1"])

        keyed = rows.mapInArrow(hashed, "doc_id long, text string, t1 long")
        keyed = keyed.join(where, (F.col("doc_id") == F.col("d")) & (keyed["t1"] == where["t1"]), "left")
        scanned = keyed.select("doc_id", "text", "at").mapInArrow(_scan(copies, None), _SCAN)
    scanned = written(scanned)
    windows = (scanned.filter("starts IS NOT NULL")
               .select("doc_id", "t1", F.explode(F.arrays_zip("starts", "w", "c")).alias("x"))
               .select("doc_id", "t1", "x.starts", "x.w", "x.c"))
    often = frequent_windows(windows)
    rest = windows.join(F.broadcast(often.select("w", "c")), ["w", "c"], "left_anti")
    least = rest.groupBy("w", "c").agg(F.min("doc_id").alias("m"))
    again = (windows.join(F.broadcast(often), ["w", "c"]).unionByName(rest.join(least, ["w", "c"]))
             .filter("doc_id > m").groupBy("doc_id", "t1").agg(F.collect_list("starts").alias("dup"))
             .select(F.col("doc_id").alias("d"), F.col("t1").alias("u"), "dup"))
    done = scanned.join(again, (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("u")), "left")
    return (done.select("doc_id", "n_words", "n_removed", "kept_sha256", "text", "dup")
            .mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
h AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM p),
m AS (SELECT w, min(doc_id) AS m FROM h GROUP BY w HAVING min(doc_id) < max(doc_id)),
s AS (SELECT r, i FROM h JOIN m USING (w) WHERE doc_id > m.m),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM s),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
y AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM x ANTI JOIN c USING (r, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (r)"""
