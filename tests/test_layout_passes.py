"""One pass a layout: all methods are ranked from one aggregation, the vectors know their own
statistics, and every layout can be made from the stored words."""

import os

import pytest
from pyspark.sql import functions as F

from parindex.operators import evaluate as E
from parindex.operators import index as D
from parindex.operators import rank as R
from parindex.operators import text as T
from parindex.operators import vector as V
from parindex.plans import catalog
from parindex.plans.querytable import query_table

WORDS = "cats dogs agreed falling buses syzygy runs the of ponies".split()
METHODS = ("tfidf", "bm25")


@pytest.fixture(scope="module", params=["once", "again"])
def corpus(spark, request):
    docs = [(i, " ".join(WORDS[(i * 3 + j * j) % len(WORDS)] for j in range(i % 9)) + "\n" + WORDS[i % 7]) for i in range(40)]
    if request.param == "again":
        docs += [docs[5], docs[5], (None, "cats runs\ncats"), (70, None), (71, "")]
    return D.corpus_from_documents(spark.createDataFrame(docs, "doc_id long, text string"))


def rows(df, *cols):
    return sorted(map(str, df.select(*cols or df.columns).collect()))


def test_methods_together_equal_each(spark, corpus):
    ix, q = D.build_index(corpus), query_table(spark, {1: "cat", 2: "cat OR dog", 3: "run AND cat"})
    v = V.index_vectors(ix)
    cols = ["query_id", "rank", "section_id", "score"]
    for df_mode in ("rows", "sections"):
        both = R.rank_methods(ix, q, METHODS, 3, df_mode=df_mode)
        for m in METHODS:
            assert rows(both.filter(F.col("method") == m), *cols) == rows(R.rank(ix, q, m, 3, df_mode=df_mode), *cols)
    both = V.vec_rank_methods(v, q, ix.num_secs(), ix.avg_sec_len(), METHODS, 3)
    for m in METHODS:
        assert rows(both.filter(F.col("method") == m), *cols) == rows(
            V.vec_rank(v, q, ix.num_secs(), ix.avg_sec_len(), m, 3), *cols)


def test_vectors_know_their_statistics(spark, corpus):
    ix = D.build_index(corpus)
    want = D.rank_vars(ix.sections).first()
    got = spark.range(1).select(*V.vector_stats(V.index_vectors(ix))).first()
    assert tuple(got) == (want["num_secs"], want["avg_sec_len"])


def test_vector_queries_write_no_index(spark, monkeypatch):
    """The vectors are the only table: the sections were once cut and written again for two numbers."""
    def never(*args):
        raise AssertionError("index asked for")
    sf = os.path.join("/root/testdata", "sf0.001")
    monkeypatch.setattr(catalog, "index", never)
    assert catalog.SPARK["vector_mixed"](spark, sf).count() > 0
    assert catalog.SPARK["idf_from_vectors"](spark, sf).count() > 0


def test_layouts_are_ranked_once(spark, monkeypatch):
    calls = []
    def counted(module, name):
        old = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or old(*a, **k))
    counted(R, "scored_hits")
    counted(V, "vector_candidates")
    catalog.SPARK["rank_agreement_layouts"](spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["scored_hits", "scored_hits", "vector_candidates"]


@pytest.mark.parametrize("length", ["words", "blank"])
def test_index_of_stored_words(spark, corpus, tmp_path, length):
    T.stored_words(T.split_sections(corpus)).write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w")).withColumn(
        "num_words", F.col("num_words_blank" if length == "blank" else "num_words"))
    want, got = D.build_index(corpus, length=length), D.index_of_words(words)
    assert rows(got.sections, *want.sections.columns) == rows(want.sections)
    assert rows(got.postings) == rows(want.postings)


def test_terms_are_counted_before_they_are_stemmed(spark):
    """Each distinct term of a block is stemmed once, however often it is in the text."""
    words = spark.createDataFrame([(1, ["cats", "cats", "cat", "the"]), (2, ["cats"]), (3, [])], "section_id long, words array<string>")
    counted = D.rows_per_stem(words, F.lit(0))
    assert [tuple(r) for r in counted.select("stem", "n").collect()] == [("cat", 3)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4  # two before the stemmer, two behind


def test_agreement_by_method(spark):
    a = spark.createDataFrame([("x", 1, 1, 5), ("x", 1, 2, 6), ("y", 1, 1, 5)], "method string, query_id int, rank int, section_id long")
    b = spark.createDataFrame([("x", 1, 1, 5), ("x", 1, 2, 7), ("y", 1, 1, 5)], "method string, query_id int, rank int, section_id long")
    assert rows(E.rank_agreement(a, b, ("method", "query_id"))) == [
        "Row(method='x', query_id=1, positions=2, mismatches=1, all_equal=False)",
        "Row(method='y', query_id=1, positions=1, mismatches=0, all_equal=True)"]
