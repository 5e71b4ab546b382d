"""Streaming sink: a replayed micro-batch rewrites only its own output, and
documents already indexed by an earlier batch are skipped."""

import os

from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.sources import store
from parindex.streaming.append import index_batch, read_streamed_index
from conftest import SF_SMALL


def test_replayed_batch_is_idempotent(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    first = docs.filter(F.col("lang") == "en")
    path = str(tmp_path / "idx")
    index_batch(first, 0, path)
    once = read_streamed_index(spark, path)
    n_sec, n_post = once.sections.count(), once.postings.count()
    index_batch(first, 0, path)          # replay of the same batch
    again = read_streamed_index(spark, path)
    assert again.sections.count() == n_sec and again.postings.count() == n_post
    index_batch(docs, 1, path)           # everything again: English documents are skipped
    both = read_streamed_index(spark, path)
    assert both.sections.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert both.sections.groupBy("section_id").count().filter("count > 1").count() == 0


def test_batch_statistics_add_up(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    path = str(tmp_path / "idx")
    for k in range(3):
        index_batch(docs.filter(F.col("doc_id") % 3 <= k), k, path)
    idx = read_streamed_index(spark, path)
    whole = D.build_index(D.corpus_from_documents(docs))
    assert sorted(idx.df_table.collect()) == sorted(D.df_table(whole.postings).collect())
    assert idx.stats.first() == D.rank_vars(whole.sections).first()
    index_batch(docs.limit(0), 3, path)  # an empty batch adds nothing
    assert read_streamed_index(spark, path).stats.first() == idx.stats.first()


def test_changed_files_change_the_state(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    before = store.input_state(spark, path)
    assert store.input_state(spark, path) == before
    spark.range(6).write.mode("append").parquet(path)
    assert store.input_state(spark, path) != before
