"""Benchmark: index build and query batches on the driver's documents table.

Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("parindex-bench")
             .config("spark.sql.shuffle.partitions", str(max(cpus, 8)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from parindex.session import checkpoint_dir
    # the session's shared checkpoint folder (a fresh scratch folder only
    # when the session names none, as in a local run)
    scratch = os.path.join(checkpoint_dir(spark), f"bench-{os.getpid()}")

    from parindex.operators import index as D
    from parindex.operators import rank as R
    from parindex.operators import search as Q
    from parindex.plans.querytable import STANDARD_QUERIES, query_table, queries_from_texts
    from parindex.sources import store

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    path = os.path.join(scratch, "index")

    def build():
        store.write_index(D.build_index(D.corpus_from_documents(docs)), path)

    timed("index_build", build)
    idx = store.read_index(spark, path)

    one = query_table(spark, {1: STANDARD_QUERIES[2]})
    std = query_table(spark, STANDARD_QUERIES)
    bench_q = queries_from_texts(spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
                                 .select(F.col("item_id").alias("query_id"), "text"))
    # every stem seen in at least five sections becomes a one-term query
    frequent = D.document_frequency(idx.postings, "sections").filter(F.col("df") >= 5)
    vocab_q = D.dense_ids(frequent, "stem", "query_id").select(
        F.col("query_id").cast("int"), F.lit("OR").alias("top_op"), F.lit(0).alias("group_id"),
        F.lit("OR").alias("group_op"), "stem").checkpoint()

    timed("lookup_single_term", lambda: run(Q.search(idx, query_table(spark, {1: "tion"}))))
    timed("bm25_1_query", lambda: run(R.rank(idx, one, "bm25", 10)))
    timed("bm25_16_queries", lambda: run(R.rank(idx, std, "bm25", 10)))
    timed("bm25_benchmark_queries", lambda: run(R.rank(idx, bench_q, "bm25", 10)))
    timed("bm25_vocab_queries", lambda: run(R.rank(idx, vocab_q, "bm25", 10)))
    timed("tfidf_16_queries", lambda: run(R.rank(idx, std, "tfidf", 10)))
    timed("tfidf_ext_16_queries", lambda: run(R.rank(idx, std, "tfidf_ext", 10)))
    timed("bm25_ext_16_queries", lambda: run(R.rank(idx, std, "bm25_ext", 10)))
    timed("rerank_two_stage_16", lambda: run(R.rerank_two_stage(idx, std, 10)))
    timed("tfidf_ext_benchmark_queries", lambda: run(R.rank(idx, bench_q, "tfidf_ext", 10)))
    timed("num_results_16", lambda: run(Q.num_results(idx, std)))

    total = round(sum(v for k, v in times.items() if k != "index_build"), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    n_vocab = vocab_q.count()
    n_bench = bench_q.select("query_id").distinct().count()
    postings_rows = idx.postings.count()
    per_query_ms = {
        "bm25_16_queries": round(1000 * times["bm25_16_queries"] / 16, 2),
        "bm25_benchmark_queries": round(1000 * times["bm25_benchmark_queries"] / max(n_bench, 1), 2),
        "bm25_vocab_queries": round(1000 * times["bm25_vocab_queries"] / max(n_vocab, 1), 3),
    }
    print(json.dumps({"metric": "total_query_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "batch_sizes": {"vocab_queries": n_vocab, "benchmark_queries": n_bench},
                      "per_query_ms": per_query_ms, "postings_rows": postings_rows}))
    spark.stop()


if __name__ == "__main__":
    main()
