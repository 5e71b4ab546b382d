"""Dictionary joins at posting level.

A dictionary has one row per term and grows with the vocabulary, so it is not
broadcast; a term that holds a large share of the postings must not land in one
task either.  Terms are split by their counts: those with more than one
``share``-th of all rows are fewer than ``share`` by counting, so their
dictionary rows are broadcast and their postings stay where they are; the
others are shuffled, and none of them has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def attach(rows: DataFrame, dictionary: DataFrame, key: str = "term", n: str = "n", share: int = SHARE) -> DataFrame:
    """``rows`` with the columns of ``dictionary``, which has each ``key`` of theirs once and its number of rows ``n``."""
    total = dictionary.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = dictionary.filter(F.col(n) * share > total).drop(n)
    rare = dictionary.filter(F.col(n) * share <= total).drop(n)
    columns = [*rows.columns, *often.drop(key).columns]
    heavy = rows.join(F.broadcast(often), key).select(*columns)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key).select(*columns)
    return heavy.unionByName(rest)
