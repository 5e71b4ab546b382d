"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least
``TIMES * q`` words long.  Within a batch of whole documents:

1. every stretch of 2^k words gets an exact name (equal stretches of a document
   have equal names), level by level from the names of its halves; a stretch
   that occurs once in its document is not named further;
2. highly periodic regions: runs of period up to ``SMALL`` are read off by
   comparing each word with the one that many words on;
3. for t = 4, 8, ...: position i synchronises if the least hash among the
   stretches of t words that begin at i..i+t is that of i or of i+t.  Stretches
   inside a run of period up to t/4 are left out, so the set stays sparse; the
   runs of smaller scales, found before, supply those periods.  Membership
   depends on the 2t words from i only, so a run of period p in [t, 2t) holds
   a synchronising position s with the same context p words on, and none
   between (two periods below 2t in that stretch would give a smaller one);
4. neighbouring positions with the same context propose (s, p), which is
   extended both ways by doubling and halving steps over the names.

Nothing is sampled or hashed for equality, so the runs are exact.  Work is
about n log n for a document of n words; documents are handled some
``BATCH_WORDS`` words at a time, a longer one alone.

Defined cases: a null text has no words; empty tables give empty tables; equal
rows have equal results; of runs with equal length/period the one that starts first, then the
one of smaller period is the greatest; columns other than id and text are not
read; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import DataFrame

from parindex.llm.common import table, text_or_empty

LEAST, TIMES = 6, 4       # a run has at least LEAST words and TIMES periods
SMALL = 3                 # periods found by comparing words directly
BATCH_WORDS = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words between space, tab, \\n, \\v, \\f and \\r, as UTF-8."""
    return (text or "").encode().split()


def _names(first: np.ndarray) -> list[np.ndarray]:
    """Level k: at i the name of the 2^k words from i, or -1 if they occur once (or leave the document).

    ``first``: names of the words, different for different documents."""
    def named(key):
        code = pd.factorize(key)[0]
        again = np.bincount(code, minlength=1)[code] > 1
        return np.where(again, code, -1).astype(np.int32)

    levels = [named(first)] if len(first) else []
    while levels and len(first) >= 2 << len(levels) - 1:
        half, step = levels[-1], 1 << len(levels) - 1
        both = np.flatnonzero((half[:-step] >= 0) & (half[step:] >= 0))
        if not len(both):
            break
        up = np.full(len(first), -1, np.int32)
        # both halves are of one document where the first words of the halves are: words of others differ,
        # so a stretch over a border occurs once
        up[both] = named(half[both].astype(np.int64) * len(first) + half[both + step])
        levels.append(up)
    return levels


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of names (splitmix finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extent(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int, forward: bool) -> np.ndarray:
    """How many words agree from positions a and b on (forward) or before them (backward)."""
    got = np.zeros(len(a), np.int64)
    for k in [*range(len(levels)), *reversed(range(len(levels)))]:
        step, live = 1 << k, np.arange(len(a))
        while len(live):
            x, y = (a[live] + got[live], b[live] + got[live]) if forward else (
                a[live] - got[live] - step, b[live] - got[live] - step)
            ok = (y < n) if forward else (x >= 0)
            live, x, y = live[ok], x[ok], y[ok]
            same = (levels[k][x] >= 0) & (levels[k][x] == levels[k][y])
            live = live[same]
            got[live] += step
            if k < len(levels) - 1:
                break  # one step a level; only the longest stretches repeat
    return got


def find_runs(first: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; ``first`` as in ``_names``."""
    n = len(first)
    found = [np.zeros((0, 3), np.int64)]
    for p in range(1, min(SMALL, n - 1) + 1):
        same = np.concatenate([[False], first[:-p] == first[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2] + p
        long = length >= TIMES * p
        start, length = start[long], length[long]
        if p > 1:  # period 1 inside: not the smallest
            smallest = first[start] != first[start + 1]
            if p == 3:
                smallest |= first[start] != first[start + 2]
            start, length = start[smallest], length[smallest]
        found.append(np.column_stack([start, length, np.full(len(start), p)]))
    levels = _names(first)
    for k in range(2, len(levels) - 1):
        t = 1 << k
        stretch, context = levels[k], levels[k + 1]
        known = np.concatenate(found)
        known = known[(known[:, 2] * TIMES <= t) & (known[:, 1] >= t)]
        deep = np.zeros(n + 1, np.int64)
        np.add.at(deep, known[:, 0], 1)
        np.add.at(deep, known[:, 0] + known[:, 1] - t + 1, -1)
        none = np.iinfo(np.uint64).max
        own = np.where((stretch >= 0) & (np.cumsum(deep[:-1]) == 0), _mixed(stretch), none)
        least = own
        for j in range(k):  # least over t places ...
            least = np.minimum(least[:len(least) - (1 << j)], least[1 << j:])
        least = np.minimum(least[:-1], least[1:])  # ... and over t + 1
        m = len(least)
        at = np.flatnonzero((least != none) & ((least == own[:m]) | (least == own[t:t + m])) & (context[:m] >= 0))
        at = at[np.argsort(context[at], kind="stable")]
        near = (context[at[:-1]] == context[at[1:]]) & (at[1:] - at[:-1] >= t) & (at[1:] - at[:-1] < 2 * t)
        s, p = at[:-1][near], (at[1:] - at[:-1])[near]
        if len(s):
            start = s - _extent(levels, s, s + p, n, False)
            length = s + p + _extent(levels, s, s + p, n, True) - start
            rows = np.column_stack([start, length, p])
            found.append(np.unique(rows[length >= TIMES * p], axis=0))
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= LEAST]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each list of words, as (start, length, period) rows."""
    sizes = np.array([len(d) for d in documents], np.int64)
    begin = np.cumsum(sizes) - sizes
    out, k = [], 0
    while k < len(documents):
        stop = max(k + 1, int(np.searchsorted(begin, begin[k] + BATCH_WORDS)))
        words = [w for d in documents[k:stop] for w in d]
        code = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(stop - k), sizes[k:stop])
        runs = find_runs(pd.factorize(code + owner * (len(words) + 1))[0])
        of = np.searchsorted(begin[k:stop] - begin[k] + sizes[k:stop], runs[:, 0], side="right")
        cut = np.searchsorted(of, np.arange(stop - k + 1))
        for j in range(stop - k):
            own = runs[cut[j]:cut[j + 1]].copy()
            own[:, 0] -= begin[k + j] - begin[k]
            out.append(own)
        k = stop
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run repeats: each run keeps its first period."""
    if not len(runs):
        return words
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, runs[:, 0] + runs[:, 2], 1)
    np.add.at(deep, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(deep[:-1]) == 0).tolist()]


def _scanned(doc_words: Iterator[list[list[bytes]]]):
    """(words, runs) of batches of documents."""
    for documents in doc_words:
        yield documents, runs_of(documents)


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``runs`` (array of start, length, period) and ``collapsed``, the text of kept words."""

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for documents, runs in _scanned(([*map(words_of, texts)] for texts in batches)):
            yield pd.DataFrame({
                "runs": [[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in runs],
                "collapsed": [b" ".join(kept_words(w, x)).decode() for w, x in zip(documents, runs)]})

    return docs.select(F.col(f"`{id_col}`"), run(text_or_empty(f"`{text_col}`")).alias("r")).select(f"`{id_col}`", "r.*")


def planted(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The contract's rows: a tenth of the documents repeat a stretch from word a on."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    names = ("start", "length", "period", "exponent_milli")

    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, "
                  "runs_sha256 string, collapsed_sha256 string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for documents, runs in _scanned(([planted(words_of(t), i) for i, t in zip(ids, texts)]
                                         for ids, texts in batches)):
            rows = []
            for words, found in zip(documents, runs):
                found_rows = found.tolist()
                best = max(found_rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                listed = "".join(f"{s},{m},{p}\n" for s, m, p in found_rows)
                rows.append((len(found_rows), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                             hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_runs", *names, "runs_sha256", "collapsed_sha256"])
            yield out.astype({c: "Int64" for c in names})

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(F.col("doc_id").cast("string"), text_or_empty()).alias("r")).select("doc_id", "r.*")
