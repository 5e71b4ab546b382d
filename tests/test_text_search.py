"""URL filter, text-search expressions and scan pruning on small corpora."""

import pytest
from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.operators import rank as R
from parindex.operators import search as Q
from parindex.operators import text as T
from parindex.operators import tsv as C
from parindex.plans.querytable import query_table
from parindex.sources import store

DOCS = [(1, "red kite over the lake"), (2, "kite red lake"), (3, "blue  lake boat"), (4, "!!!"),
        (5, "red kite red kite boat")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, f"doc-{i}", t) for i, t in DOCS], "doc_id long, title string, doc string")


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ix") / "index")
    store.write_index(D.build_index(corpus), path)
    return store.read_index(spark, path)


def expressions(spark, rows):
    return spark.createDataFrame(rows, C.EXPRESSION_SCHEMA)


def found(df):
    return sorted((r.query_id, T_doc(r.section_id)) for r in df.collect())


def T_doc(section_id):
    return section_id >> T.SECTION_BITS


def test_url_filter_drops_hosts_and_keeps_their_slot(spark):
    s = spark.createDataFrame([(1, 1, 0, "see www.harbour.example or (ships.museum), not 3.5 www. end")],
                              "section_id long, doc_id long, para_idx int, section string")
    rows = {r.term: r.offset for r in T.tokens_no_url(s, stop="none").collect()}
    assert rows == {"see": 1, "or": 3, "not": 5, "3.5": 6, "www": 7, "end": 8}
    mail = s.withColumn("section", F.lit("write to a.b@quay.example now"))
    assert [r.term for r in T.tokens_no_url(mail, stop="none", clean=False).orderBy("offset").collect()] \
        == ["write", "to", "now"]


def test_expression_combines_not_or_phrase(spark, stored):
    ex = expressions(spark, [
        (1, 0, 0, False, 0, "red", 0), (1, 0, 0, False, 1, "kite", 1),       # red <1> kite
        (1, 1, 0, True, 0, "boat", 0),                                       # & !boat
        (2, 0, 0, True, 0, "lake", 0),                                       # !lake
        (3, 0, 0, False, 0, "red", 0), (3, 0, 0, False, 0, "blue", 0),       # (red | blue) <1> (kite | lake)
        (3, 0, 0, False, 1, "kite", 1), (3, 0, 0, False, 1, "lake", 1),
        (4, 0, 0, False, 0, "absent", 0)])
    assert found(C.match_expression(stored, ex)) == [
        (1, 1), (2, 4), (2, 5), (3, 1), (3, 2), (3, 3), (3, 5)]


def test_blank_length_counts_every_part(corpus):
    ix = D.build_index(corpus, length="blank")
    assert {T_doc(r.section_id): r.num_words for r in ix.sections.collect()} == {1: 5, 2: 3, 3: 4, 4: 1, 5: 5}


def test_rank_freq_flags(spark, stored):
    q = query_table(spark, {1: "red OR boat"})
    rows = {T_doc(r.section_id): r.score for r in C.rank_freq(stored, q).collect()}
    assert rows == {1: 0.5, 2: 0.5, 3: 0.5, 5: 1.125}
    with pytest.raises(ValueError):
        C.rank_freq(stored, q, norm=2)


def test_derived_queries_prune_the_scan(spark, stored, tmp_path):
    query_table(spark, {1: "red OR lake"}).write.parquet(str(tmp_path / "q"))
    derived = Q.prepare_queries(spark.read.parquet(str(tmp_path / "q")))
    plan = Q.pruned_postings(stored, derived)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0].replace("isnotnull(bucket", "")
    assert "In(stem" in scan
    local = R.rank(stored, query_table(spark, {1: "red OR lake"}), "bm25").collect()
    assert R.rank(stored, derived, "bm25").collect() == local
