"""Score-bounded ranking equals ranking every hit, and leaves most hits out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from parindex.operators import bounds as B
from parindex.operators import index as D
from parindex.operators import rank as R
from parindex.operators import search as Q
from parindex.plans.querytable import queries_from_texts, query_table
from parindex.sources import store

METHODS = ("tfidf", "bm25", "tfidf_ext", "bm25_ext")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bounds") / "index")
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    store.write_index(D.build_index(D.corpus_from_documents(docs)), path)
    return store.read_index(spark, path)


@pytest.fixture(scope="module")
def long_queries(spark):
    items = spark.read.parquet(os.path.join(SF_SMALL, "benchmark.parquet")).filter("item_id % 4 = 0")
    return Q.prepare_queries(queries_from_texts(items.select(F.col("item_id").alias("query_id"), "text")))


@pytest.fixture(scope="module")
def random_index(spark):
    """Few frequent words, so that nearly every section is a hit and ties abound."""
    rnd = random.Random(5)
    words = [f"w{chr(97 + j)}x" for j in range(12)]
    weights = [40, 30, 20, 10, 8, 6, 4, 3, 2, 1, 1, 1]
    docs = [(i, f"doc-{i}", " ".join(rnd.choices(words, weights, k=rnd.randint(1, 40)))) for i in range(400)]
    corpus = spark.createDataFrame(docs, "doc_id long, title string, doc string")
    ix = D.build_index(corpus)
    return D.TextIndex(sections=ix.sections.cache(), tokens=None, postings=ix.postings.cache()), words


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("method", METHODS)
def test_long_queries(stored, long_queries, method):
    got = rows(R.rank(stored, long_queries, method, 5, prune=True))
    assert got == rows(R.rank(stored, long_queries, method, 5, prune=False)) and got


@pytest.mark.parametrize("method,args", [("tfidf_ext", {}), ("tfidf_ext", {"span_mode": "as_written"}),
                                         ("bm25_ext", {}), ("bm25_ext", {"p4_mode": "rasolofo"}),
                                         ("bm25", {"k1": 1.2, "b": 0.3})])
def test_random_index(spark, random_index, method, args):
    index, words = random_index
    rnd = random.Random(9)
    texts = {i: " OR ".join(rnd.sample(words, rnd.randint(1, 12))) for i in range(12)}
    texts |= {20: f"{words[0]} AND {words[1]}", 21: f"({words[0]} OR {words[9]}) AND ({words[2]} OR {words[10]})",
              22: "absent", 23: f"absent AND {words[3]}"}
    q = query_table(spark, texts)
    for k in (1, 4):
        assert rows(R.rank(index, q, method, k, prune=True, **args)) == rows(
            R.rank(index, q, method, k, prune=False, **args))


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_rankings(stored, long_queries, broadcast, monkeypatch):
    if not broadcast:  # the flag of essential stems crosses with the postings
        monkeypatch.setattr(B, "MAX_BROADCAST_QUERY_ROWS", 0)
    assert rows(R.rank_all(stored, long_queries, 3, prune=True)) == rows(R.rank_all(stored, long_queries, 3, prune=False))


def test_most_hits_are_left_out(stored, long_queries):
    parts = Q.query_parts(stored, long_queries)
    kept = B.kept_pairs(stored, long_queries, parts, ("tfidf_ext",), 5).count()
    hits = Q.search(stored, long_queries).count()
    n = long_queries.select("query_id").distinct().count()
    assert 5 * n <= kept < hits / 4


def test_bounds_hold(spark, random_index):
    """No stem's partial score and no section's bonus exceeds its bound."""
    index, words = random_index
    q = query_table(spark, {1: " OR ".join(words)})
    terms = B.bounded_terms(index, q, Q.query_parts(index, q)[0])
    p = index.postings.join(terms.drop("df"), "stem")
    from parindex.functions import scoring as S
    over = p.filter((S.tfidf_term(F.col("tf"), F.col("idf")) > B.greatest_partial("tfidf") + 1e-9) | (S.bm25_term(
        F.col("tf"), F.col("bm25idf"), F.col("num_words"), index.avg_sec_len(), 1.7, 0.75) > B.greatest_partial("bm25") + 1e-9))
    assert over.count() == 0
    h = R.proximity_columns(Q.scored_hits(index, q, with_offsets=True), index.avg_sec_len())
    bonus = (F.col("min_dist") + F.col("min_span")) / F.col("nj")
    most = B.hit_bonus("tfidf_ext", "intended", index.avg_sec_len(), index.num_secs())
    assert h.filter((bonus > most + 1e-9) | (bonus > 2.5)).count() == 0
    extra = B.hit_bonus("bm25_ext", "intended", index.avg_sec_len(), index.num_secs())
    assert h.filter(F.col("prox_bm25") > extra + 1e-9).count() == 0
