"""Supplied lemma tables (T7, T8) where one term holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.operators import text as T

LEMMAS = {"ran": "run", "mice": "mouse", "the": "a"}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, f"doc-{i}", "mice " * (i % 5 + 3) + f"ran cats word{i} word{i % 7} mouse") for i in range(200)]
    return spark.createDataFrame(docs, "doc_id long, title string, doc string")


@pytest.fixture(scope="module")
def lemmas(spark):
    return spark.createDataFrame(list(LEMMAS.items()), "term string, lemma string")


def lemma(term):
    return LEMMAS.get(term, term[:-1] if term == "cats" else term)


def test_tokens_and_postings(spark, corpus, lemmas):
    ix = D.build_index(corpus, lemma_table=lemmas)
    plain = D.build_index(corpus, lemma_rule="none")
    want = sorted((r.section_id, r.offset, r.term, lemma(r.term)) for r in plain.tokens.collect())
    assert sorted((r.section_id, r.offset, r.term, r.stem) for r in ix.tokens.collect()) == want
    merged: dict = {}
    for s, o, term, st in want:
        merged.setdefault((s, st), []).append((o, term))
    got = {(r.section_id, r.stem): (r.tf, r.n_terms, r.offsets) for r in ix.postings.collect()}
    assert got == {k: (len(v), len({t for _, t in v}), sorted(o for o, _ in v)) for k, v in merged.items()}


def test_heavy_term_is_not_shuffled(spark, corpus, lemmas):
    """The rows of the frequent terms meet their lemmas by broadcast."""
    toks = D.build_index(corpus, lemma_rule="none").tokens.drop("stem")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.lemmatize(toks, lemmas)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_classes(spark, corpus):
    toks = D.build_index(corpus, lemma_rule="none").tokens.select("section_id", "offset", "term")
    tags = toks.select("section_id", "offset", F.when(F.col("term") == "ran", "VBD").when(
        F.col("term") == "cats", None).when(F.col("term").startswith("m"), "NNS").otherwise("XX").alias("tag"))
    table = spark.createDataFrame([("ran", "v", "run"), ("ran", "n", "wrong"), ("mice", "n", "mouse"), ("cats", "n", "cat")],
                                  "term string, pos string, lemma string")
    got = T.lemmatize_pos(toks, tags, table)
    assert sorted(got.columns) == ["offset", "section_id", "stem", "term"]
    known = {"ran": "run", "mice": "mouse"}
    assert sorted(map(tuple, got.select("section_id", "offset", "term", "stem").collect())) == sorted(
        (r.section_id, r.offset, r.term, known.get(r.term, r.term)) for r in toks.collect())


def test_tags_are_not_read_for_the_counts(spark):
    """The tokens meet their tags once, in the result; lemmas that come twice, or are null, count as before."""
    toks = spark.createDataFrame([(1, 1, "ran"), (1, 2, "mice"), (2, 1, "ran"), (2, 2, "cats"), (None, 1, "ran")],
                                 "section_id long, offset int, term string")
    read = spark.sparkContext.accumulator(0)

    def tag(row):
        read.add(1)
        return row

    tags = spark.createDataFrame(spark.sparkContext.parallelize(
        [(1, 1, "VBD"), (1, 2, "NNS"), (2, 1, "JJ"), (2, 2, "NNS")]).map(tag), "section_id long, offset int, tag string")
    table = spark.createDataFrame([("ran", "v", "run"), ("mice", "n", "mouse"), ("mice", "n", "mus"), ("cats", "n", None),
                                   ("ran", "", "other")], "term string, pos string, lemma string")
    got = T.lemmatize_pos(toks, tags, table)
    assert read.value == 0
    assert sorted(map(str, got.select("section_id", "offset", "term", "stem").collect())) == sorted(map(str, spark.createDataFrame(
        [(1, 1, "ran", "run"), (1, 2, "mice", "mouse"), (1, 2, "mice", "mus"), (2, 1, "ran", "other"), (2, 2, "cats", "cats"),
         (None, 1, "ran", "other")], "section_id long, offset int, term string, stem string").collect()))
