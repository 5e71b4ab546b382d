"""Score bounds: the sections that can still reach a query's top-k.

1. *Thresholds.*  A first round scores, per query, some sections that hold its rarest
   stems; the k-th best score without proximity among them cannot exceed the query's k-th best
   score.  Any sections would do (too few matches only leave a query without a threshold).
2. *Essential stems.*  A stem's greatest partial score follows from its greatest tf, stored with the
   term statistics.  Taken from the least bound on, stems are idle while their bounds together
   with the largest proximity bonus stay below the threshold: a section with idle stems only cannot
   reach the top-k.  Sections with at least one other, essential, stem are the candidates; the
   frequent stems, which hold most postings, are rarely essential.
3. *Hits.*  Candidates are scored without offsets; those whose score and largest bonus reach the
   threshold are kept, and only they get their offsets gathered.

What is written is the query table's size in steps 1 and 2 and the kept pairs in
step 3, never the list of all hits.  Scores are compared as they are ranked, rounded to
six digits; rounding is monotone, so what is left out ranks below k others.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parindex.functions import scoring as S
from parindex.functions.sizing import MAX_BROADCAST_QUERY_ROWS, small_side
from parindex.operators.index import (BM25_B, BM25_EXT_B, BM25_EXT_K1, BM25_K1, TextIndex, add_bucket_like,
                                      join_keys)
from parindex.operators.search import pruned_postings, pushed_stems, scored_hits
from parindex.session import checkpoint_dir

# sections per place of the top-k that the first round asks for
FIRST_ROUND = 16
# a batch that names fewer postings is ranked in one pass: the rounds are small jobs of their own
PRUNE_ABOVE = 1_000_000
SLACK = 1e-6
#: the score without proximity of each method
BASE = {"tfidf": "tfidf", "tfidf_ext": "tfidf", "bm25": "bm25", "bm25_ext": "bm25_ext"}
NO_BOUND = -1e300


def postings_named(terms: DataFrame) -> int:
    """(section, term) rows of all query stems together, from the term statistics."""
    return terms.agg(F.coalesce(F.sum("df"), F.lit(0)).cast("long")).first()[0]


def greatest_partial(method: str, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """The most that one stem can add: its ``max_tf`` in the shortest section."""
    tf = F.col("max_tf").cast("double")
    if BASE[method] == "tfidf":
        most = S.tfidf_term(F.col("max_tf"), F.col("idf"))
    else:
        k, c = (BM25_EXT_K1, BM25_EXT_B) if method == "bm25_ext" else (k1, b)
        most = (k + 1.0) * tf / (k * (1.0 - c) + tf) * F.col("bm25idf")
    return F.greatest(most, F.lit(0.0))


def greatest_bonus(method: str, span_mode: str, k3: float, stems: Column, top_idf: Column) -> Column:
    """The largest proximity bonus of a section that holds at most ``stems`` query stems.

    TF-IDF: two stems give at most 1/2 + 2; with n of them and ``nj >= n`` occurrences at most
    ``nj`` position pairs have a given distance d, so the distances add at most
    ``nj * pi^2/6`` and the span at most ``(n/(n-1))^2`` (n^2 as written), both divided by nj."""
    n = stems.cast("double")
    if method == "tfidf_ext":
        bonus = n + pi * pi / 6 if span_mode == "as_written" else F.lit(2.5)
    elif method == "bm25_ext":
        bonus = ((BM25_EXT_K1 + 1.0) * max(1.0, 1.0 / (2.0 * (1.0 - BM25_EXT_B))) * n * (n - 1) / 2
                 * F.greatest(top_idf, F.lit(0.0)) / k3)
    else:
        return F.lit(0.0)
    return F.when(stems >= 2, bonus).otherwise(F.lit(0.0))


def hit_bonus(method: str, span_mode: str, avg: Column, num_secs: Column, k3: float = 1000.0) -> Column:
    """Largest possible proximity bonus of a hit from what the cheap aggregate
    knows: ``n_present`` stems, ``nj`` occurrences, its length.

    * TF-IDF: distances add at most C(n,2) and nj * pi^2/6, the span (n/(n-1))^2 (it is at least
      n-1) or n^2 as written; divided by nj;
    * BM25: (k1+1) * max(1, 1/u) * C(n,2) * (largest possible bm25idf) / k3,
      which covers both P4 modes."""
    n, nj = F.col("n_present").cast("double"), F.col("nj").cast("double")
    pairs = n * (n - 1) / 2
    if method == "tfidf_ext":
        span = (n * n) if span_mode == "as_written" else (n / (n - 1)) * (n / (n - 1))
        most = (F.least(pairs, nj * (pi * pi / 6)) + span) / nj
    elif method == "bm25_ext":
        u = 2.0 * ((1.0 - BM25_EXT_B) + BM25_EXT_B * (F.col("num_words").cast("double") / avg))
        max_idf = F.log10(1.0 + (num_secs.cast("double") - 0.5) / 1.5)
        most = (BM25_EXT_K1 + 1.0) * F.greatest(F.lit(1.0), 1.0 / u) * pairs * max_idf / k3
    else:
        return F.lit(0.0)
    return F.when(n >= 2, most).otherwise(F.lit(0.0))


def bounded_terms(index: TextIndex, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """The query stems with their greatest tf: stored, or else from their postings."""
    stored = index.df_table
    if stored is not None and "max_tf" in stored.columns:
        listed = pushed_stems(queries)
        tops = stored.select("stem", "max_tf")
        if listed is not None:
            tops = tops.filter(F.col("stem").isin(listed) if listed else F.lit(False))
    else:
        named = add_bucket_like(index.postings, terms.select("stem").distinct())
        tops = (pruned_postings(index, queries).join(small_side(named, bound=queries), join_keys(index.postings), "left_semi")
                .groupBy("stem").agg(F.max("tf").alias("max_tf")))
    return tops.join(small_side(terms, bound=queries), "stem").select(*terms.columns, "max_tf")


def first_sections(index: TextIndex, queries: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query, section) pairs of the first round: about ``FIRST_ROUND * k`` per query, of its rarest
    stems; a stem that alone has more gives an even share of its sections."""
    limit = FIRST_ROUND * k
    earlier = Window.partitionBy("query_id").orderBy("df", "stem").rowsBetween(Window.unboundedPreceding, -1)
    rare = (terms.withColumn("before", F.coalesce(F.sum("df").over(earlier), F.lit(0)))
            .filter(F.col("before") < limit)
            .select("query_id", "stem", F.greatest(F.lit(1), F.floor(F.col("df") / limit)).alias("every")))
    rare = add_bucket_like(index.postings, rare)
    p = pruned_postings(index, queries).join(small_side(rare, bound=queries), join_keys(index.postings))
    return p.filter(F.pmod(F.xxhash64("section_id"), F.col("every")) == 0).select("query_id", "section_id").distinct()


def kth_scores(scores: DataFrame, methods: tuple[str, ...], k: int) -> DataFrame:
    """``(query_id, thr_<method>…)``: the k-th best ``lb_<method>``, rounded; null with fewer than k hits."""
    long = scores.select("query_id", "section_id", F.explode(F.array(*[F.struct(
        F.lit(m).alias("method"), S.rounded(F.col(f"lb_{m}")).alias("score")) for m in methods])).alias("x")) \
        .select("query_id", "section_id", "x.*")
    w = Window.partitionBy("query_id", "method").orderBy(F.col("score").desc(), F.col("section_id").desc())
    best = long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.groupBy("query_id").agg(*[
        F.max(F.when((F.col("method") == m) & (F.col("rank") == k), F.col("score"))).alias(f"thr_{m}") for m in methods])


def with_essential(terms: DataFrame, thresholds: DataFrame, methods: tuple[str, ...], span_mode: str, k3: float,
                   k1: float, b: float) -> DataFrame:
    """``terms`` with ``essential``: whether some method's top-k can hold a section through this stem."""
    out = terms.join(thresholds, "query_id", "left")
    needed = F.lit(False)
    for m in methods:
        upto = Window.partitionBy("query_id").orderBy(greatest_partial(m, k1, b), "stem") \
            .rowsBetween(Window.unboundedPreceding, 0)
        most = (F.sum(greatest_partial(m, k1, b)).over(upto)
                + greatest_bonus(m, span_mode, k3, F.count(F.lit(1)).over(upto), F.max("bm25idf").over(upto)))
        needed = needed | F.coalesce(most >= F.col(f"thr_{m}") - SLACK, F.lit(True))
    return out.withColumn("essential", needed).select(*terms.columns, "essential")


def kept_pairs(index: TextIndex, queries: DataFrame, parts: tuple[DataFrame, DataFrame], methods: tuple[str, ...],
               k: int, span_mode: str = "intended", k3: float = 1000.0, k1: float = BM25_K1,
               b: float = BM25_B) -> DataFrame:
    """The (query, section) pairs that can be in the top-k of one of ``methods``; ``parts`` as from
    ``search.query_parts``.  A query with a negative BM25 IDF (more rows than sections) keeps all its hits."""
    checkpoint_dir(queries.sparkSession)
    scores = tuple(sorted({BASE[m] for m in methods}))
    given, qdef = parts
    terms = bounded_terms(index, queries, given).checkpoint()
    odd = terms.groupBy("query_id").agg((F.min("bm25idf") < 0).alias("odd"))

    def bounds(hits, extra=()):
        hits = hits.join(small_side(odd, bound=queries), "query_id")
        return hits.select("query_id", "section_id", *extra, *[F.when(F.col("odd"), F.lit(NO_BOUND)).otherwise(
            F.col(BASE[m])).alias(f"lb_{m}") for m in methods], *[
            (F.col(BASE[m]) + hit_bonus(m, span_mode, index.avg_sec_len(), index.num_secs(), k3)).alias(f"ub_{m}")
            for m in methods])

    def reaching(found, thresholds):
        keep = F.lit(False)
        for m in methods:
            keep = keep | F.coalesce(F.col(f"ub_{m}") >= F.col(f"thr_{m}") - SLACK, F.lit(True))
        return found.join(small_side(thresholds, bound=queries), "query_id", "left").filter(keep) \
            .select(*found.columns)

    def hits(**restriction):
        return scored_hits(index, queries, scores=scores, bm25_k1=k1, bm25_b=b, **restriction)

    first = first_sections(index, queries, terms, k).checkpoint()
    thresholds = kth_scores(bounds(hits(parts=(given, qdef), restrict=small_side(first))), methods, k).checkpoint()
    flagged = with_essential(terms, thresholds, methods, span_mode, k3, k1, b).checkpoint()
    needed = flagged.filter("essential")
    if postings_named(needed) <= MAX_BROADCAST_QUERY_ROWS:
        # at most so many pairs: they are told to the scan of all stems, so only candidates are shuffled
        stems = add_bucket_like(index.postings, needed.select("query_id", "stem"))
        pairs = pruned_postings(index, queries).join(small_side(stems, bound=queries), join_keys(index.postings)) \
            .select("query_id", "section_id")
        second = hits(parts=(given, qdef), restrict=F.broadcast(pairs))
    else:
        second = hits(parts=(flagged.drop("max_tf"), qdef))  # the flag crosses with the postings
    kept = reaching(bounds(second), thresholds).checkpoint()
    return reaching(kept, kth_scores(kept, methods, k)).select("query_id", "section_id")
