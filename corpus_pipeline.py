"""Cleaning and packing a corpus: language ID, SimHash near-dedup, benchmark
decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``, whatever they are; rows with nulls, repeated
rows and an empty table pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parindex.llm import decontaminate, language_id, packing, secrets, simhash
from parindex.llm.common import fresh, table, text_or_empty
from parindex.session import checkpoint_dir



def least_language_score(languages: int) -> float:
    """A text whose pooled probability of its best language is below this is rejected:
    1.6 times what an even guess gives, and never more than 0.4."""
    return min(0.4, 1.6 / max(languages, 1))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no learned language explains."""
    out, = fresh(docs, "lang_id")
    model = language_id.fit(docs, language_id.learnable())
    found = language_id.identify(docs, model, out=out)
    if not model["langs"]:  # nothing to learn from: only texts without a letter go
        return docs.filter(text_or_empty().rlike(r"\p{L}"))
    return found.filter((F.col(f"{out}.lang_pred") != "und")
                        & (F.col(f"{out}.score") >= least_language_score(len(model["langs"])))).drop(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id.

    Of repeated rows with that id one stays; a component of rows without ids
    keeps one row."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span, linked weak parts included, by a mark."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text"))
                             .cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained language model nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{k}_{name}")
    return docs
