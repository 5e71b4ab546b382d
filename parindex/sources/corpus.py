"""Corpus sources (S1, S2) and the driver's tables.

* CSV without header, columns assigned by position as ``title, doc``; an
  optional first row to skip; multi-line quoted fields (documents hold
  newlines).  Files are cut into records block by block (``sources.csv_blocks``), so one
  large file is read by many tasks.
* TSV passages ``pid, passage`` (one passage per line — splittable).
* Parquet tables with ``doc_id, text`` (the test data).

Every reader returns ``(doc_id, title, doc)``; ``doc_id`` is assigned from the
file order without a global window (``monotonically_increasing_id`` plus a
per-partition offset, see ``operators.index.dense_ids``) when the source has no
id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parindex.sources.csv_blocks import csv_records


def with_row_ids(df: DataFrame, col: str = "doc_id") -> DataFrame:
    """Consecutive 0-based ids in input order: per-partition counts are
    prefix-summed (a handful of numbers) and added to the position inside the
    partition."""
    d = df.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    from parindex.functions.sizing import per_partition
    return d.join(per_partition(offs), "__pid").withColumn(
        col, F.col("__off") + F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)) \
        .drop("__pid", "__mid", "__off")


def read_csv_corpus(spark: SparkSession, path: str, skip_first: bool = False) -> DataFrame:
    """``title, doc`` CSV (no header), optionally skipping each file's first row."""
    fields = F.from_csv("text", "title string, doc string", {"escape": '"', "multiLine": "true"})
    return csv_records(spark, path, skip_first).select(F.col("rec").alias("doc_id"), fields.alias("c")) \
        .select("doc_id", "c.title", "c.doc")


def read_tsv_passages(spark: SparkSession, path: str) -> DataFrame:
    """``pid \\t passage`` lines; the passage id is the document id, a quote
    is a character like any other."""
    raw = spark.read.schema("pid long, passage string").option("sep", "\t").option("quote", "").csv(path)
    return raw.select(F.col("pid").alias("doc_id"), F.col("pid").cast("string").alias("title"),
                      F.col("passage").alias("doc"))


def read_parquet_corpus(spark: SparkSession, path: str, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(
        F.col(id_col).alias("doc_id"),
        F.concat(F.lit("doc-"), F.col(id_col).cast("string")).alias("title"),
        F.col(text_col).alias("doc"))


def conversation_sections(conversations: DataFrame) -> DataFrame:
    """The conversations table as a corpus already cut into sections: one
    section per turn, the conversation being the document."""
    from parindex.operators.text import section_id
    return conversations.select(section_id(F.col("conv_id"), F.col("turn")), F.col("conv_id").alias("doc_id"),
                                F.col("turn").alias("para_idx"), F.col("text").alias("section")) \
        .filter(F.col("section").isNotNull() & (F.col("section") != ""))
