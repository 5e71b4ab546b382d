"""Vectors, lexeme postings and counts made in a section's own row equal the grouped ones, also where
document ids repeat or are null; readers of the sections write no postings."""

import os

import pytest
from pyspark.sql import functions as F

from parindex.functions import porter
from parindex.operators import index as D
from parindex.operators import maintain as M
from parindex.operators import text as T
from parindex.operators import tsv as C
from parindex.operators import vector as V
from parindex.sources import store

WORDS = "relational hopping ponies the cats cat's étés syzygy running runs ran falling falls of agreed buses".split()


@pytest.fixture(scope="module", params=["once", "again"])
def corpus(spark, request):
    docs = [(i, " ".join(WORDS[(i * 3 + j * j) % len(WORDS)] for j in range(i % 9)) + "\n" + WORDS[i % 7]) for i in range(60)]
    if request.param == "again":
        docs += [docs[5], docs[5], docs[8], (None, "cats ran\ncats"), (None, "cats"), (70, None), (71, "")]
    return D.corpus_from_documents(spark.createDataFrame(docs, "doc_id long, text string"))


def rows(df, *cols):
    return sorted(map(str, df.select(*cols or df.columns).collect()))


def test_vectors_equal_grouped_tokens(spark, corpus):
    ix = D.build_index(corpus)
    want = V.section_vectors(ix.tokens, ix.sections)
    assert rows(V.index_vectors(ix), *want.columns) == rows(want)


def test_vectors_are_not_shuffled(spark):
    ix = D.build_index(D.corpus_from_documents(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("cats ran").alias("text"))))
    assert "Exchange" not in V.index_vectors(ix)._jdf.queryExecution().executedPlan().toString()


def test_section_offsets_equal_grouped_postings(spark, corpus):
    ix = D.build_index(corpus)
    grouped = T.postings(ix.tokens).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("term", "offsets"))).alias("e"))
    want = grouped.select("section_id", F.flatten(F.transform("e", lambda e: e["offsets"])).alias("offsets"))
    assert rows(V.section_offsets(ix)) == rows(want)


def test_concatenated_offsets_are_not_shuffled(spark, tmp_path):
    from parindex.plans import catalog
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("cats ran\ncats").alias("text")).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = catalog.SPARK["concat_agg"](spark, str(tmp_path))
    assert got.count() == 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_lexemes_equal_joined_terms(spark, corpus, tmp_path):
    surface = D.build_index(corpus, lemma_rule="none", length="blank")
    store.write_index(surface, str(tmp_path / "surface"))
    want = C.lexeme_index(store.read_index(spark, str(tmp_path / "surface")))  # by the stored terms
    got = C.lexeme_index(surface)
    cols = ["section_id", "stem", "tf", "n_terms", "offsets", "num_words"]
    assert rows(got.postings, *cols) == rows(want.postings, *cols)
    store.write_index(got, str(tmp_path / "lexemes"))
    assert rows(store.read_index(spark, str(tmp_path / "lexemes")).postings, *cols) == rows(want.postings, *cols)
    assert rows(C.tsvector_table(got)) == rows(C.tsvector_table(want))


def test_rows_per_stem(spark, corpus):
    ix = D.build_index(corpus)
    want = D.inline_postings(ix.words).groupBy("stem").agg(F.sum("n_terms").alias("n"))
    assert rows(D.rows_per_stem(ix.words, F.lit(0)), "stem", "n") == rows(want, "stem", "n")


def test_porter_word_equals_cascade(spark):
    words = WORDS + ("caress agreed plastered motoring sing conflated troubled sized tanned hissing fizzed failing filing happy "
                     "sky conditional digitizer vietnamization decisiveness formaliti triplicate electriciti hopeful revival "
                     "adjustment adoption controll roll rate cease yes y ayed eed ooing").split()
    for r in porter.lexemes(spark.createDataFrame([(w,) for w in words], "term string")).collect():
        assert porter.porter_word(r.term) == r.lexeme


def test_sections_write_no_postings(spark, corpus):
    ix = store.materialized(spark, {"test": "lazy", "n": corpus.count()}, lambda: D.build_index(corpus))
    assert ix.sections.count() == D.build_index(corpus).sections.count() and ix.num_secs() is not None
    assert os.path.isdir(f"{ix.path}/sections") and not os.path.isdir(f"{ix.path}/postings")
    assert ix.df_table.count() == ix.postings.select("stem").distinct().count()


def test_large_corpus_has_more_parts(spark, monkeypatch):
    sections = spark.range(1000).select(F.lit(5).alias("num_words"))
    assert store.default_parts(sections) == 8
    monkeypatch.setattr(store, "PART_WORDS", 100)
    assert store.default_parts(sections) == 50


def test_nested_get(spark):
    """In the order of the nested arrays, each once; outside indices give nothing."""
    df = spark.createDataFrame([([[1], [2, 3], [], [4]], [4, 1, 1, 9, 0]), ([[1]], []), (None, [1]), ([[1]], None)],
                               "nested array<array<int>>, i array<int>")
    got = V.nested_get(F.col("nested"), F.col("i"))
    assert [r[0] for r in df.select(got).collect()] == [[1, 4], [], None, []]
    # a membership test in the lambda would evaluate the indices once an element
    assert "array_contains" not in df.select(got)._jdf.queryExecution().optimizedPlan().toString()


def test_vocab_gc_needs_no_grouped_postings(spark, corpus):
    v = D.vocabulary(D.build_index(corpus).tokens, D.stem_dict(D.build_index(corpus).tokens))
    ix = D.build_index(corpus, lemma_rule="none", postings="inline")
    kept, _ = M.vocab_gc(v, v.select("stem_id"), ix.postings.withColumnRenamed("stem", "term"))
    want, _ = M.vocab_gc(v, v.select("stem_id"), T.postings(D.build_index(corpus).tokens))
    assert rows(kept) == rows(want)
