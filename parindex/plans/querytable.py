"""Structured query tables.

Every search and ranking operator takes a table of queries; one query is the
one-row case.  Layout (one row per term occurrence in a group):

    queries(query_id int, top_op string, group_id int, group_op string, stem string)

``top_op`` joins the groups (AND/OR), ``group_op`` joins the terms of a group
(AND/OR).  Text-search queries add ``neg`` (NOT) and phrase steps, see
``operators.tsv``.

``parse_query`` is a small driver-side helper for hand-written query strings
(the reference's grammar: one term; ``a OR b``; ``a AND b``; parenthesised
flat groups joined by AND or OR).  Large batches are built as DataFrames,
e.g. ``queries_from_texts``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = "query_id int, top_op string, group_id int, group_op string, stem string"


def _flat(part: str) -> tuple[str, list[str]]:
    part = part.strip()
    if " OR " in part and " AND " not in part:
        return "OR", [t.strip() for t in part.split(" OR ")]
    if " AND " in part and " OR " not in part:
        return "AND", [t.strip() for t in part.split(" AND ")]
    if " AND " in part or " OR " in part:
        raise ValueError(f"a group mixes AND and OR: {part!r}")
    return "OR", [part]


def parse_query(text: str) -> list[tuple[str, int, str, str]]:
    """Query string -> ``[(top_op, group_id, group_op, stem), …]``."""
    text = text.strip()
    if "(" not in text:
        op, terms = _flat(text)
        return [(op, 0, op, t) for t in terms]
    groups: list[tuple[str, list[str]]] = []
    tops: set[str] = set()
    rest = text
    pos = 0
    for m in re.finditer(r"\(([^()]*)\)|(\bAND\b|\bOR\b)|([^\s()]+)", rest):
        if m.group(1) is not None:
            groups.append(_flat(m.group(1)))
        elif m.group(2) is not None:
            tops.add(m.group(2))
        else:
            groups.append(("OR", [m.group(3)]))
        pos = m.end()
    if len(tops) > 1:
        raise ValueError(f"top level mixes AND and OR: {text!r}")
    top = tops.pop() if tops else "OR"
    return [(top, gi, op, t) for gi, (op, terms) in enumerate(groups) for t in terms]


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_lit(x) for x in v) + ")"
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql_lit(x)}" for k, x in v.items()) + ")"
    return repr(v)


def _split_schema(schema: str) -> list[list[str]]:
    """Top-level ``name type`` pairs of a DDL string (commas inside <> kept)."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    return [c.strip().split(" ", 1) for c in out]


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small parameter table as a SQL ``VALUES`` relation: Catalyst sees a
    LocalRelation with its exact size (no job to measure it, folded at
    planning time where possible)."""
    cols = _split_schema(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    names = ", ".join(n for n, _ in cols)
    values = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return df.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in cols])


def query_table(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """Hand-written queries -> structured query table (a small local relation)."""
    rows = [(int(qid), top, gid, gop, stem)
            for qid, text in queries.items() for (top, gid, gop, stem) in parse_query(text)]
    return local_table(spark, rows, QUERY_SCHEMA)


def queries_from_texts(texts: DataFrame, stop="nltk", lemma_rule: str = "s_stemmer") -> DataFrame:
    """``(query_id, text)`` -> one OR query per row over its analysed words
    (same tokeniser, stop list and lemma rule as the index)."""
    from parindex.functions import text as tx
    from parindex.operators.text import lemma_column
    words = texts.select(F.col("query_id").cast("int").alias("query_id"),
                         F.explode(tx.word_array(F.col("text"))).alias("term"))
    stops = tx.stop_words(stop)
    if stops:
        words = words.filter(~F.col("term").isin(stops))
    return words.select("query_id", F.lit("OR").alias("top_op"), F.lit(0).alias("group_id"),
                        F.lit("OR").alias("group_op"),
                        lemma_column(F.col("term"), lemma_rule).alias("stem")).distinct()


# Fixed query lists of the test plan (tokens that occur in the test corpus).
STANDARD_QUERIES = {
    1: "tion",
    2: "tion OR erin",
    3: "tion AND erin",
    4: "(tion OR eron) AND (erin OR erth)",
    5: "(tion AND erin) OR (eron AND erth)",
    6: "tion AND zzznope",
    7: "zzznope",
    8: "tion AND erin AND thnd",
    9: "tion AND erin AND thnd AND eron",
    10: "tion AND erin AND thnd AND eron AND erth",
    11: "tion OR erin OR thnd",
    12: "tion OR erin OR thnd OR eron",
    13: "tion OR erin OR thnd OR eron OR erth",
    14: "eron AND erth",
    15: "(tion AND erin) OR erth",
    16: "tion OR tion",
}
