"""Token counts as an exact length histogram.

Every text is encoded once to its length; lengths are counted.  All answers
come from suffix sums over the distinct lengths: documents at least that long,
their tokens, and the tokens that remain when every document is cut to a
context limit.  The suffix sums have two levels (blocks of lengths, then
inside a block), so no task holds all lengths.

Defined cases: a null or empty text has length 0; repeated rows count each;
an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parindex.llm import tokens
from parindex.llm.common import table, text_or_empty

BLOCK = 1024


def document_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the number of ids of the whole text."""
    path = path or tokens.default_path()

    def run(batches):
        for batch in batches:
            n = [len(tokens.encode(t, path)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long"))


def length_histogram(lengths: DataFrame, n_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length L.

    ``n_docs`` have length L; ``docs_at_least`` / ``tokens_at_least`` are the
    suffix sums; ``truncated_total`` is the corpus total with every document
    cut to L tokens; ``quantile`` is the share of documents of length <= L.
    """
    hist = lengths.groupBy(F.col(n_col).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK))
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    # one row per block of lengths: as many as the longest text has blocks of tokens
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding,
                                                        Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_d"),
                           F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_t"),
                           F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("all_t"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    # every length has its block; the left join adds no null test on one side only, so
    # both sides read the same exchange and the texts are encoded once
    hist = hist.join(blocks, "block", "left")
    at_least_d = F.sum("n_docs").over(inside) + F.col("later_d")
    at_least_t = F.sum("n_tokens").over(inside) + F.col("later_t")
    hist = hist.select("length", "n_docs", at_least_d.alias("docs_at_least"),
                       at_least_t.alias("tokens_at_least"), "all_d", "all_t")
    return hist.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
        .alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_d")).alias("quantile"),
        F.col("all_d").alias("total_docs"), F.col("all_t").alias("total_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Corpus tokens with every document cut to ``limit`` ids, for any limit."""
    return hist.agg(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")).alias("tokens"))


def quantile_length(hist: DataFrame, q: float) -> DataFrame:
    """The least length with at least a share ``q`` of the documents at or below it."""
    return hist.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(document_lengths(table(spark, sf_dir, "documents")))
