"""Helpers shared by the operators: reading, folds, bounded samples, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parindex.session import checkpoint_dir

#: characters that separate words: space, tab, \n, \v, \f, \r
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet (any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def held_out(id_col: Column, n: int, remainder: int) -> Column:
    """True for the held-out fold; a null id is not held out (nor learnt from)."""
    return F.coalesce(fold(id_col, n) == remainder, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, keys: list[str], bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``keys`` (all rows if fewer).

    One counting pass sets the share of hash values that is kept, so no sort
    and no single task is needed; equal input gives an equal sample.
    """
    n = df.count()
    if n <= bound:
        return df
    share = int(bound / n * (1 << 30))
    hashed = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30))
    return df.filter(hashed < share)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: checkpoint into the shared folder of the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared folder and read back.

    For intermediate results too bulky for ``cut`` (columnar, compressed)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keys: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``keys``, which has each ``key`` once with its number of rows ``n``.

    Keys with more than one ``share``-th of all rows, fewer than ``share`` keys
    by counting, are broadcast, so their rows stay where they are; the others
    are shuffled, and none of them has more rows than that."""
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = keys.filter(F.col("n") * share > total).drop("n")
    rare = keys.filter(F.col("n") * share <= total).drop("n")
    return (rows.join(F.broadcast(often), key).select(*rows.columns, *often.drop(key).columns)
            .union(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key)
                   .select(*rows.columns, *often.drop(key).columns)))
