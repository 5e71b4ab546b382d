"""Equi-depth ranges of the stored postings: balance with a hot stem, whole rows, one write."""

import random

from pyspark.sql import functions as F

from parindex.operators import index as D
from parindex.operators import layout as L
from parindex.sources import store


def _corpus(spark, docs, hot):
    rng = random.Random(3)
    rows = []
    for d in range(docs):
        words = [f"w{rng.randrange(400)}x" for _ in range(6)]
        # the hot word is in every section of the second half, as one source would have it
        rows.append((d, f"t{d}", " ".join(([hot] * 2 if d >= docs // 2 else []) + words)))
    return spark.createDataFrame(rows, "doc_id long, title string, doc string")


def _file_sizes(spark, path):
    return [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f"))
            .agg(F.count(F.lit(1)).alias("n")).collect()]


def test_hot_stem_is_cut_by_section_range(spark, tmp_path):
    path = str(tmp_path / "idx")
    built = D.build_index(_corpus(spark, 4000, "hotword"))
    spark.conf.set("parindex.buckets", "2")
    try:
        store.write_index(built, path, num_partitions=40)
    finally:
        spark.conf.unset("parindex.buckets")
    sizes = _file_sizes(spark, f"{path}/postings")
    total = built.postings.count()
    words = built.sections.agg(F.sum("num_words")).first()[0]
    assert sum(sizes) == total
    assert max(sizes) <= total / 40 + words / (8 * 40) + 1 + total / (4 * 40)
    hot = spark.read.parquet(f"{path}/postings").filter(F.col("stem") == "hotword") \
        .groupBy(F.input_file_name().alias("f")).agg(F.min("section_id").alias("a"), F.max("section_id").alias("b")) \
        .orderBy("a").collect()
    assert len(hot) >= 2000 // (total / 40) >= 3 and all(x["b"] < y["a"] for x, y in zip(hot, hot[1:]))


def test_stored_postings_and_terms_equal_memory(spark, tmp_path):
    path = str(tmp_path / "idx")
    built = D.build_index(_corpus(spark, 300, "don't"))
    for index in (built, D.TextIndex(built.sections, None, built.postings)):
        store.write_index(index, path)
        disk = store.read_index(spark, path)
        cols = ["section_id", "stem", "tf", "n_terms", "offsets", "num_words"]
        assert sorted(map(tuple, disk.postings.select(cols).collect())) == sorted(map(tuple, built.postings.select(cols).collect()))
        assert sorted(disk.df_table.select("stem", "df_rows", "df_sections").collect()) == sorted(
            D.df_table(built.postings).collect())


def test_no_rows_and_empty_sections(spark, tmp_path):
    built = D.build_index(spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "the of")],
                                                "doc_id long, title string, doc string"))
    store.write_index(built, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx/terms")).count() == 0
    assert L.part_count([]) == 1


def test_every_posting_crosses_one_exchange(spark):
    built = D.build_index(_corpus(spark, 50, "hot"))
    rows = store.with_bucket(D.inline_postings(built.words, **built.analysis), 2)
    laid = L.equi_depth_layout(rows, [(0, 0, []), (1, 1, [{"key": "w2x", "cut": L.LOWEST}])]) \
        .repartitionById(3, F.col("part")).sortWithinPartitions("bucket", "stem", "section_id")
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1
