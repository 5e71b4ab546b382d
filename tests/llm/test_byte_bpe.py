"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import pytest
import tiktoken

from parindex.llm import byte_bpe


@pytest.fixture(scope="module")
def both():
    c = byte_bpe.codec()
    return c, tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=c.ranks, special_tokens={})


def test_ids_equal_the_library(both):
    c, library = both
    rnd = random.Random(5)
    signs = ["abc", "a", "aab", " \n\t", "été ö日本語", "0123456789", "'s'll", "😀#*$%\x1c\x85\xa0"]
    for _ in range(1500):
        text = "".join(rnd.choices("".join(rnd.sample(signs, 3)), k=rnd.randrange(200)))
        ids = c.encode(text)
        assert ids == library.encode_ordinary(text) and c.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "x" + "é" * 30_000, " " * 20_000 + "z", "", " "])
def test_very_long_pieces(both, text):
    c, library = both
    ids = c.encode(text)
    assert ids == library.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_random_ranks_with_overlapping_splits():
    """Ranks that no training gives: a merge may make a pair of lower rank, or of its own rank further left."""
    rnd = random.Random(9)
    for _ in range(300):
        tokens = {bytes((b,)) for b in range(256)} | {bytes(rnd.choices(b"ab", k=rnd.randrange(2, 6))) for _ in range(12)}
        more = sorted(t for t in tokens if len(t) > 1)
        rnd.shuffle(more)
        ranks = {bytes((b,)): b for b in range(256)} | {t: 256 + i for i, t in enumerate(more)}
        tables = byte_bpe._tables(ranks)
        for _ in range(10):
            piece = bytes(rnd.choices(b"ab", k=rnd.randrange(1, 60)))
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while True:  # plain: least rank, then leftmost
                ready = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not ready:
                    break
                _, i = min(ready)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert byte_bpe.merge(piece, ranks, tables) == [ranks[t] for t in parts]


def test_long_pieces_in_arrays(both, monkeypatch):
    c, _ = both
    rnd = random.Random(2)
    piece = "".join(rnd.choices("abcdefgh", k=3000)).encode()
    want = byte_bpe.merge(piece, c.ranks, c.pieces.pairs)
    monkeypatch.setattr(byte_bpe, "_LONG", 10)
    assert byte_bpe.merge(piece, c.ranks, c.pieces.pairs) == want


def test_documents_round_trip(spark):
    rows = [(1, "some words, été", 3), (2, None, 4), (3, "", 5), (1, "some words, été", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS long")
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(df)).collect()
    assert [bytes(r.decoded).decode() for r in got] == ["some words, été", "", "", "some words, été"]
    assert got[0].ids and list(got[1].ids) == []  # the taken name is replaced


def test_query_digests(spark, both):
    c, library = both
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in byte_bpe.op12_byte_bpe(spark, path).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
