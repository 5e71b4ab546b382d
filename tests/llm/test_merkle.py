"""Merkle manifest against a plain tree, with small blocks so that several rounds run."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parindex.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
        i //= 3
    return out


@pytest.mark.parametrize("height", [1, 2, 5])
def test_against_plain_trees(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** height)
    rnd = random.Random(height)
    sizes = {"": 1, "=": 2, "=a": 3, "=b": 200, "=c": 28, "=d": 9, "=e": 27, "=é": 4, "=z": 1}
    rows = [(k, i, sha(k, str(i))) for k, n in sizes.items() for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, doc_id long, digest string").withColumn("kept", F.col("doc_id") + 1)
    got = {(r.kept, r.leaf): r for r in merkle.manifest(df).collect()}
    trees = {k: plain([sha(k, str(i)) for i in range(n)]) for k, n in sizes.items()}
    order = sorted(sizes, key=str.encode)
    top = plain([trees[k][-1][0] for k in order])
    assert len(got) == len(rows)
    for nth, k in enumerate(order):
        for i in range(sizes[k]):
            r = got[i + 1, trees[k][0][i]]
            assert (r.subroot, r.root) == (trees[k][-1][0], top[-1][0])
            steps = [s for s in plain_path(trees[k], i) + plain_path(top, nth)]
            assert [tuple(s) for s in r.path] == steps


def test_one_source_one_row_and_tampering(spark, tmp_path):
    rows = [(d, f"line {d}\nnext", "en", "s", 5) for d in range(40)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    import zlib
    for r in got:
        odd = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2 == 1
        assert r.verified is odd and (r.folded_root == r.root) is odd
    none = next(r for r in got if r.doc_id is None)
    assert none.leaf == none.subroot == sha("-----")


def test_equal_rows_fill_places_of_their_own(spark):
    rows = [("=s", 7, sha("same"))] * 100 + [("=s", 8, sha("other"))]
    df = spark.createDataFrame(rows, "key string, doc_id long, digest string")
    got = merkle.ranked(df, "key", ["doc_id", "digest"]).collect()
    assert sorted(r.place for r in got) == list(range(101)) and {r.n for r in got} == {101}
