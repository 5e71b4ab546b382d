"""Work per row that does not grow with the corpus or with the section."""

from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.operators import layout as L
from parindex.operators import vector as V
from parindex.plans.querytable import query_table

DOCS = [(i, " ".join(["cats", "dog", "birds", "fish", "cat"][(i * j) % 5] for j in range(1, 8))) for i in range(40)]
QUERIES = {1: "cat", 2: "bird AND dog", 3: "fish OR cat", 4: "nothing"}


def vectors(spark):
    return V.index_vectors(D.build_index(D.corpus_from_documents(spark.createDataFrame(DOCS, "doc_id long, text string"))))


def test_count_up_to_equals_a_scan(spark):
    for n in (0, 1, 2, 7, 8, 9):
        bounds = [3 * k for k in range(n)]
        rows = spark.createDataFrame([(v,) for v in [None, *range(-1, 30)]], "at long")
        found = rows.select("at", L.block_of(F.col("at"), bounds).alias("n")).collect()
        assert all(r.n == sum(b <= r.at for b in bounds) if r.at is not None else r.n == 0 for r in found)


def test_parts_are_found_by_halving(spark):
    bounds = [{"key": f"w{k:03}", "cut": L.LOWEST if k % 2 else 5} for k in range(100)]
    rows = spark.createDataFrame([(0, f"w{k:03}", s) for k in range(100) for s in (None, 4, 5)],
                                 "bucket int, stem string, section_id long")
    laid = L.equi_depth_layout(rows, [(0, 0, bounds), (1, 101, [])])
    for r in laid.collect():
        assert r.part == sum(b["key"] < r.stem or (b["key"] == r.stem and r.section_id is not None
                                                   and b["cut"] <= r.section_id) for b in bounds)
    assert "filter(bounds" not in laid._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_hold_only_named_entries(spark):
    n = F.lit(len(DOCS))
    c = V.vector_candidates(vectors(spark), query_table(spark, QUERIES), n).collect()
    assert {r.query_id for r in c} == {1, 2, 3}
    assert {s for r in c for s in r.stems} == {"cat", "bird", "dog", "fish"}
    assert all(len(r.stems) == len(r.terms) == len(r.offsets) == len(r.frequencies) for r in c)
    few = V.vector_candidates(vectors(spark), query_table(spark, {1: "cat"}), n).collect()
    assert few and all(r.terms in (["cat"], ["cats"], ["cat", "cats"]) and set(r.stems) == {"cat"} for r in few)


def test_vectors_are_read_once_for_idf(spark, tmp_path):
    vectors(spark).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    ranked = V.vec_rank(stored, query_table(spark, QUERIES), F.lit(len(DOCS)), F.lit(7.0), "tfidf", 3)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    want = V.vec_rank(stored, query_table(spark, QUERIES), F.lit(len(DOCS)), F.lit(7.0), "tfidf_ext", 3)
    assert {r.query_id for r in ranked.collect()} == {r.query_id for r in want.collect()} == {1, 2, 3}
