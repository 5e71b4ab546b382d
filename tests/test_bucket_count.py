"""A stored index is read with its own bucket count, whatever the session says."""

import pytest
from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.operators import search as Q
from parindex.operators import text as T
from parindex.plans.querytable import query_table
from parindex.sources import store
from parindex.streaming import append

DOCS = [(i, " ".join(f"w{j}" for j in range(i, i + 12)), "en", "s", 0) for i in range(20)]


def _hits(spark, idx):
    q = query_table(spark, {k: f"w{k}" for k in range(25)})
    return sorted(tuple(r) for r in Q.search(idx, q).select("query_id", "section_id").collect())


def test_other_bucket_setting_reads_the_same(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, append.DOC_SCHEMA)
    built = D.build_index(D.corpus_from_documents(docs))
    spark.conf.set("parindex.buckets", "64")
    try:
        store.write_index(built, str(tmp_path / "idx"))
        append.index_batch(docs.union(docs), 0, str(tmp_path / "stream"))
    finally:
        spark.conf.unset("parindex.buckets")
    want = _hits(spark, built)
    assert len(want) > 200
    assert _hits(spark, store.read_index(spark, str(tmp_path / "idx"))) == want
    assert _hits(spark, append.read_streamed_index(spark, str(tmp_path / "stream"))) == want


def test_section_ids_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, 1 << 20)], "d long, p int")
    with pytest.raises(Exception, match="too large"):
        df.select(T.section_id(F.col("d"), F.col("p"))).collect()
