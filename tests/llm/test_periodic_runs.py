"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib

from parindex.llm import periodic_runs
from parindex.llm.periodic_runs import runs_of


def brute(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            stretch = w[i:i + size]
            if j > i and size >= max(6, 4 * p) and not any(
                    stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd):
    n, kind = rnd.randrange(160), rnd.randrange(4)
    if kind == 0:
        return rnd.choices("ab", k=n)
    if kind == 1:
        return (rnd.choices("ab", k=rnd.randrange(1, 30)) * 100)[:n]
    if kind == 2:
        w = []
        while len(w) < n:
            w += rnd.choices("abc", k=rnd.randrange(1, 12)) * rnd.randrange(1, 7)
            w = (w + w[-rnd.randrange(1, len(w) + 1):] * rnd.randrange(5))[:500]
        return w
    block = []
    for _ in range(3):
        block = block * 2 + rnd.choices("ab", k=rnd.randrange(3)) + ["a"] * rnd.randrange(6)
    return (block * 6)[:n + 40]


def test_random_documents(monkeypatch):
    rnd = random.Random(11)
    docs = [some_words(rnd) for _ in range(2000)]
    want = [brute(w) for w in docs]
    coded = [[x.encode() for x in w] for w in docs]
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(coded)] == want
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 100)
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(coded)] == want


def test_long_documents():
    rnd = random.Random(1)
    noise = [b"w%d" % rnd.randrange(1000) for _ in range(50_000)]
    block = [b"v%d" % i for i in range(5000)]
    got, one, none = runs_of([noise + block * 5 + noise, [b"a"] * 200_000, []])
    assert [50_000, 25_000, 5000] in got.tolist()
    assert one.tolist() == [[0, 200_000, 1]] and not len(none)


def test_operator_keeps_first_period(spark):
    df = spark.createDataFrame([(1, "x " + "go on " * 5 + "y"), (2, None), (3, "a b"), (1, "a b")],
                               "doc_id long, text string")
    got = periodic_runs.detect_runs(df).collect()
    assert [(r.start, r.length, r.period) for r in got[0].runs] == [(1, 10, 2)] and got[0].collapsed == "x go on y"
    assert [(r.runs, r.collapsed) for r in got[1:]] == [([], ""), ([], "a b"), ([], "a b")]


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    some = 0
    for r in periodic_runs.op13_periodic_runs(spark, path).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute(w)
        drop = {i for s, m, p in runs for i in range(s + p, s + m)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(
            " ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
        some += bool(runs)
        if runs:
            best = max(r2[1] / r2[2] for r2 in runs)
            assert abs(r.length / r.period - best) < 1e-9 and r.exponent_milli == 1000 * r.length // r.period
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert some
