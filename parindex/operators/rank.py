"""Relevance ranking of Boolean hits.

Every ranking is ``scored_hits`` (one exchange keyed by (query, section)) plus
a per-query top-k.  The top-k is ``row_number() <= k`` over
``partitionBy(query_id)``: Spark inserts a partial WindowGroupLimit before the
exchange, so each map task forwards at most k rows per query and a query that
matches a third of the corpus never lands whole in one task.

Scores are computed in double; the order is (score rounded to 6 digits DESC,
section_id DESC) — the reference's tie-break — and the rounded score is the
output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parindex.functions import proximity as P
from parindex.functions import scoring as S
from parindex.operators import bounds
from parindex.operators.index import BM25_B, BM25_K1, TextIndex, weight
from parindex.operators.search import (normalise_queries, prepare_queries, pruned_postings, query_parts, scored_hits,
                                       small_side)
from parindex.operators.text import doc_of_section

METHODS = ("tfidf", "tfidf_doclen", "bm25", "tfidf_ext", "bm25_ext")


def top_k(scored: DataFrame, k: int, score: str = "score", part: str = "query_id",
          rank_col: str = "rank") -> DataFrame:
    """Per-query top-k by (score DESC, section_id DESC)."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col("section_id").desc())
    return scored.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_k_by(h: DataFrame, methods: tuple[str, ...], k: int) -> DataFrame:
    """Top-k of every method over rows that hold all their scores."""
    long = h.select("query_id", "section_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), S.rounded(method_score(m)).alias("score"))
        for m in methods])).alias("m")).select("query_id", "section_id", "m.method", "m.score")
    w = Window.partitionBy("query_id", "method").orderBy(F.col("score").desc(), F.col("section_id").desc())
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "method", "rank", "section_id", "score")


def with_lists_index(h: DataFrame) -> DataFrame:
    """Number the present query stems 0..n-1 (in stem order) for the fold."""
    lists = F.array_sort(F.col("lists"))
    return h.withColumn("lists", F.transform(
        lists, lambda l, i: F.struct(i.alias("k"), l["offsets"].alias("offsets"),
                                     l["bm25idf"].alias("bm25idf"), l["idf"].alias("idf"))))


def proximity_columns(h: DataFrame, avg: Column, span_mode: str = "intended",
                      k3: float = 1000.0, need_bm25: bool = True, p4_mode: str = "as_written") -> DataFrame:
    """Adds ``min_dist``, ``min_span``, ``prox_bm25`` from the fold.

    ``p4_mode="as_written"``: (k1+1)/u per pair of lists with some distance
    < 6 (the reference's ``tpi`` cancels); ``"rasolofo"``: tpi/(u + tpi) with
    tpi over all close position pairs."""
    h = with_lists_index(h)
    n = F.size("lists")
    # one stem present: every proximity measure is 0, so the fold is skipped
    h = h.withColumn("__fold", F.when(n >= 2, P.proximity_fold(F.col("lists"))))
    cols = {
        "min_dist": P.min_dist_sum(F.col("__fold"), n),
        "min_span": P.min_span_score(F.col("__fold"), n, span_mode),
    }
    if need_bm25:
        idfs = F.transform("lists", lambda l: l["bm25idf"])
        if p4_mode == "as_written":
            cols["prox_bm25"] = P.bm25_proximity(F.col("__fold"), n, idfs, F.col("num_words"), avg, k3=k3)
        elif p4_mode == "rasolofo":
            h = h.withColumn("__avg", avg)
            cols["prox_bm25"] = P.bm25_proximity_rasolofo(F.col("lists"), n, idfs, F.col("num_words"),
                                                          F.col("__avg"), k3=k3)
        else:
            raise ValueError(f"unknown p4_mode {p4_mode!r}")
    return h.withColumns(cols).drop("__fold", "__avg") if "__avg" in h.columns else \
        h.withColumns(cols).drop("__fold")


def method_score(method: str) -> Column:
    if method == "tfidf":
        return F.col("tfidf")
    if method == "tfidf_doclen":
        return F.col("tfidf") * weight(F.col("num_words"))
    if method == "bm25":
        return F.col("bm25")
    if method == "tfidf_ext":
        return F.col("tfidf") + (F.col("min_dist") + F.col("min_span")) / F.col("nj").cast("double")
    if method == "bm25_ext":
        return F.col("bm25_ext") + F.col("prox_bm25")
    raise ValueError(f"unknown ranking method {method!r}")


def rank(index: TextIndex, queries: DataFrame, method: str = "bm25", k: int = 10,
         unknown: str = "drop", df_mode: str = "rows", span_mode: str = "intended",
         k3: float = 1000.0, p4_mode: str = "as_written",
         k1: float | None = None, b: float | None = None, prune: bool | None = None) -> DataFrame:
    """``(query_id, rank, section_id, score)`` top-k per query.

    ``k1``/``b`` set BM25's parameters (defaults 1.7 / 0.75 as in the
    reference; a search engine's BM25 is the same formula with its own).
    ``prune``: find the sections that can reach the top-k first (``operators.bounds``); by
    default with proximity, where the batch names many postings.  The rows are the same."""
    proximity = method in ("tfidf_ext", "bm25_ext")
    needed = {"tfidf": ("tfidf",), "tfidf_doclen": ("tfidf",), "bm25": ("bm25",),
              "tfidf_ext": ("tfidf",), "bm25_ext": ("bm25_ext",)}[method]
    queries = prepare_queries(queries)
    bk1, bb = (BM25_K1 if k1 is None else k1), (BM25_B if b is None else b)
    parts = query_parts(index, queries, unknown, df_mode)
    restrict = None
    if prune is None:
        prune = proximity and bounds.postings_named(parts[0]) > bounds.PRUNE_ABOVE
    if prune and method in bounds.BASE:
        restrict = small_side(bounds.kept_pairs(index, queries, parts, (method,), k, span_mode, k3, bk1, bb))
    h = scored_hits(index, queries, with_offsets=proximity, scores=needed,
                    bm25_k1=bk1, bm25_b=bb, restrict=restrict, parts=parts)
    if proximity:
        h = proximity_columns(h, index.avg_sec_len(), span_mode, k3, need_bm25=method == "bm25_ext",
                              p4_mode=p4_mode)
    scored = h.select("query_id", "section_id", S.rounded(method_score(method)).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")


def rank_all(index: TextIndex, queries: DataFrame, k: int = 10, unknown: str = "drop",
             span_mode: str = "intended", prune: bool | None = None) -> DataFrame:
    """The four rankings of ``run_test`` (tfidf, bm25, tfidf_ext,
    bm25_ext) from one aggregation; one row per (query, method, rank).

    ``prune`` as in :func:`rank`: offsets are gathered only for sections that can reach
    the top-k of one of the four."""
    queries = prepare_queries(queries)
    parts = query_parts(index, queries, unknown)
    methods = ("tfidf", "bm25", "tfidf_ext", "bm25_ext")
    if prune is None:
        prune = bounds.postings_named(parts[0]) > bounds.PRUNE_ABOVE
    restrict = small_side(bounds.kept_pairs(index, queries, parts, methods, k, span_mode)) if prune else None
    h = scored_hits(index, queries, with_offsets=True, scores=("tfidf", "bm25", "bm25_ext"), restrict=restrict,
                    parts=parts)
    h = proximity_columns(h, index.avg_sec_len(), span_mode)
    return top_k_by(h, methods, k)


def rank_methods(index: TextIndex, queries: DataFrame, methods: tuple[str, ...], k: int = 10, unknown: str = "drop",
                 df_mode: str = "rows") -> DataFrame:
    """The rankings of several ``methods`` without proximity from one aggregation; one row
    per (query, method, rank)."""
    scores = tuple(sorted({"bm25" if m == "bm25" else "tfidf" for m in methods}))
    return top_k_by(scored_hits(index, queries, unknown, df_mode, scores=scores), methods, k)


def rerank_two_stage(index: TextIndex, queries: DataFrame, k: int = 10, unknown: str = "drop",
                     span_mode: str = "intended") -> DataFrame:
    """Top-k by TF-IDF x section weight, then those k re-ordered by
    TF-IDF + proximity.  The fold runs on k sections per query only: the
    postings of the query stems are semi-joined with the (broadcast, k rows per
    query) first-stage result before offsets are gathered."""
    queries = prepare_queries(queries)
    first = rank(index, queries, "tfidf_doclen", k, unknown)
    n_queries = normalise_queries(queries).select("query_id").distinct()
    keep = small_side(first.select("query_id", "section_id"), bound=n_queries,
                      max_rows=max(1, 1_000_000 // max(k, 1)))
    qs, _ = query_parts(index, queries, unknown)
    from parindex.operators.index import add_bucket_like, join_keys
    qs = add_bucket_like(index.postings, qs)
    p = pruned_postings(index, queries).join(small_side(qs, bound=queries), join_keys(index.postings)) \
        .join(keep, ["query_id", "section_id"], "left_semi")
    h = p.groupBy("query_id", "section_id").agg(
        F.sum(S.tfidf_term(F.col("tf"), F.col("idf"))).alias("tfidf"),
        F.sum("tf").cast("long").alias("nj"),
        F.max("num_words").alias("num_words"),
        F.collect_list(F.struct("stem", "offsets", "bm25idf", "idf")).alias("lists"))
    h = proximity_columns(h, index.avg_sec_len(), span_mode, need_bm25=False)
    scored = h.select("query_id", "section_id", S.rounded(method_score("tfidf_ext")).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")


def ranked_titles(ranked: DataFrame, corpus: DataFrame, queries: DataFrame | None = None,
                  k: int = 10) -> DataFrame:
    """Titles of ranked sections, aligned by section.  With the query
    table the ranked side (at most k rows a query) is broadcast when that
    bound is small; the ranking itself is never run for its size."""
    if queries is None:
        side = lambda r: r
    else:
        n_queries = normalise_queries(queries).select("query_id").distinct()
        side = lambda r: small_side(r, bound=n_queries, max_rows=max(1, 1_000_000 // max(k, 1)))
    r = ranked.withColumn("doc_id", doc_of_section(F.col("section_id")))
    return corpus.select("doc_id", "title").join(side(r), "doc_id") \
        .select("query_id", "rank", "section_id", "title", "score")


def score_trunc(ranked: DataFrame, digits: int = 3) -> DataFrame:
    """Scores truncated as the reference's client shows them."""
    return ranked.withColumn("score_trunc", S.truncate(F.col("score"), digits))
