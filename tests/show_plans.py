"""Print the physical plans of the headline queries (tree + scan details).

    python tests/show_plans.py /root/testdata/sf0.01 > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(title: str, df) -> None:
    text = formatted(df)
    tree, _, details = text.partition("\n\n\n")
    print(f"## {title}\n\n```")
    print(tree.strip())
    for block in details.split("\n\n"):
        if block.lstrip().startswith("(") and "Scan" in block.split("\n", 1)[0]:
            keep = [ln for ln in block.split("\n")
                    if re.match(r"^\(\d+\)|^(PushedFilters|PartitionFilters|ReadSchema|Location)", ln)]
            print("\n".join(keep))
    print("```\n")


def main() -> None:
    from pyspark.sql import functions as F
    from parindex import get_spark
    from parindex.operators import index as D
    from parindex.operators import rank as R
    from parindex.operators import search as Q
    from parindex.plans.querytable import STANDARD_QUERIES, queries_from_texts, query_table
    from parindex.sources import store
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    path = tempfile.mkdtemp(prefix="plans-", dir=os.environ.get("TMPDIR", "/tmp"))
    corpus = D.corpus_from_documents(spark.read.parquet(os.path.join(sf, "documents.parquet")))
    built = D.build_index(corpus)
    print(f"# Physical plans ({os.path.basename(sf)}, local[8])\n")
    summary("Index build: postings (tokenise -> partial aggregate -> one exchange)", built.postings)
    store.write_index(built, os.path.join(path, "idx"))
    idx = store.read_index(spark, os.path.join(path, "idx"))
    std = query_table(spark, STANDARD_QUERIES)
    bq = queries_from_texts(spark.read.parquet(os.path.join(sf, "benchmark.parquet"))
                            .select(F.col("item_id").alias("query_id"), "text"))
    summary("BM25 top-10, 16 hand-written queries (local query table: stem and bucket lists pushed into the scan)",
            R.rank(idx, std, "bm25", 10))
    summary("BM25 top-10, one OR query per benchmark item (query table derived from data)",
            R.rank(idx, bq, "bm25", 10))
    summary("TF-IDF + proximity top-10 (fold over collected offsets)", R.rank(idx, std, "tfidf_ext", 10))
    summary("Boolean search, result counts", Q.num_results(idx, std))


if __name__ == "__main__":
    main()
