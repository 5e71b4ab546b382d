"""The postings layout and the per-section vector layout rank alike
(R1 = R7, R3 = R8, R4 = R9, R5 = R10) on the same query table."""

import os

import pytest

from parindex.operators import index as D
from parindex.operators import rank as R
from parindex.operators import vector as V
from parindex.plans.querytable import STANDARD_QUERIES, query_table
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def built(spark):
    corpus = D.corpus_from_documents(spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")))
    idx = D.build_index(corpus)
    vec = V.section_vectors(idx.tokens, idx.sections).cache()
    return idx, vec


@pytest.mark.parametrize("method", ["tfidf", "bm25", "tfidf_ext", "bm25_ext"])
def test_postings_equal_vectors(spark, built, method):
    idx, vec = built
    q = query_table(spark, STANDARD_QUERIES)
    a = sorted(map(tuple, R.rank(idx, q, method, 10).collect()))
    b = sorted(map(tuple, V.vec_rank(vec, q, idx.num_secs(), idx.avg_sec_len(), method, 10).collect()))
    assert a == b and len(a) > 0
