"""Per-section vector layout and array operators (D6, D10, Q6–Q8, R7–R11,
P5–P10, P12).

A section row holds parallel arrays, one entry per surface term (sorted by
term): ``terms``, ``stems``, ``offsets`` (array of sorted offset arrays) and
``frequencies``, and a ``signature``: a bitmap of 512 bits of its stems.

Batch search/ranking over vectors needs no aggregation at all:

1. the query table is flattened to one row per (query, stem) and broadcast;
2. the stems of a section meet it inside the section's own row: no array is
   shuffled and the vectors are never joined back to themselves;
3. the signature is tested before the arrays (a bit that is not set proves a stem absent);
   then of a (query, section) pair's rows the one with the *smallest* shared stem is
   kept, and Boolean predicates and scores are higher-order functions over the row's
   arrays (``forall``/``exists``/``filter``/``aggregate``);
4. per-query top-k through ``row_number`` (partial WindowGroupLimit).

A query table too large to be broadcast meets ``(section_id, stem)`` rows instead, and the
arrays join its candidate pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.functions import proximity as P
from parindex.functions import scoring as S
from parindex.functions.entries import SIGNATURE_WORDS, tsvectors_of, vectors_of
from parindex.functions.text import stop_words
from parindex.operators.index import (BM25_B, BM25_EXT_B, BM25_EXT_K1, BM25_K1, TextIndex,
                                      idf_view, rank_vars, repeated_sections, sections_again, sections_once)
from parindex.operators import text as T
from parindex.operators.rank import top_k, top_k_by
from parindex.functions.sizing import fits_broadcast
from parindex.operators.search import (boolean_match, normalise_queries, prepare_queries, query_stems,
                                       small_side)

def signature(stems: Column) -> Column:
    """Bitmap of the stems' hashes, as an array of 64-bit words."""
    def add(words, s):
        bit = F.pmod(F.crc32(s.cast("binary")), F.lit(64 * SIGNATURE_WORDS)).cast("int")
        return F.transform(words, lambda v, w: F.when(w == F.shiftright(bit, 6), v.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63))))).otherwise(v))
    return F.aggregate(stems, F.array_repeat(F.lit(0).cast("long"), SIGNATURE_WORDS), add)


def signature_match(groups: Column, words: Column, top_op: Column) -> Column:
    """False only where :func:`boolean_match` is: every word of an AND group's
    signature has to be covered, one bit of an OR group's has to be set."""
    def group_ok(g):
        both = F.zip_with(g["signature"], words, lambda a, b: F.struct(a.alias("a"), a.bitwiseAND(b).alias("h")))
        return g["ok"] & F.when(g["group_op"] == "AND", F.forall(both, lambda x: x["h"] == x["a"])) \
            .otherwise(F.exists(both, lambda x: x["h"] != 0))
    return F.when(top_op == "AND", F.forall(groups, group_ok)).otherwise(F.exists(groups, group_ok))


def section_vectors(tokens: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """``(section_id, terms, stems, offsets, frequencies, num_words, signature)``.

    Sections without a kept term get empty arrays when ``sections`` is given."""
    tp = (tokens.groupBy("section_id", "term", "stem")
          .agg(F.array_sort(F.collect_list("offset")).alias("offsets"),
               F.count(F.lit(1)).cast("int").alias("tf"),
               F.max("num_words").alias("num_words")))
    v = tp.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "stem", "offsets", "tf"))).alias("e"),
        F.max("num_words").alias("num_words"))
    v = v.select("section_id",
                 F.transform("e", lambda x: x["term"]).alias("terms"),
                 F.transform("e", lambda x: x["stem"]).alias("stems"),
                 F.transform("e", lambda x: x["offsets"]).alias("offsets"),
                 F.transform("e", lambda x: x["tf"]).alias("frequencies"),
                 "num_words")
    if sections is None:
        return v.withColumn("signature", signature(F.col("stems")))
    empty_s = F.array().cast("array<string>")
    s = sections.select("section_id", F.col("num_words").alias("__nw"))
    j = s.join(v.drop("num_words"), "section_id", "left")
    return j.select("section_id",
                    F.coalesce("terms", empty_s).alias("terms"),
                    F.coalesce("stems", empty_s).alias("stems"),
                    F.coalesce("offsets", F.array().cast("array<array<int>>")).alias("offsets"),
                    F.coalesce("frequencies", F.array().cast("array<int>")).alias("frequencies"),
                    F.col("__nw").alias("num_words")).withColumn("signature", signature(F.col("stems")))


def index_vectors(index: TextIndex) -> DataFrame:
    """D6 of an index built in memory: a section's vectors are made in its own row, without a
    shuffle; only the tokens of section ids that several rows have are grouped."""
    rows = lambda words: vectors_of(words, stop_words(index.analysis["stop"]), index.analysis["lemma_rule"])
    again = repeated_sections(index.sections)
    if again is None:
        return rows(index.words)
    grouped = section_vectors(sections_again(index.tokens, again), sections_again(index.sections, again))
    return rows(sections_once(index.words, again)).unionByName(grouped)


def section_offsets(index: TextIndex) -> DataFrame:
    """P12 over T13 of an index built in memory: ``(section_id, offsets)``, the offset lists of a section's
    terms concatenated in the order of the terms.  The lists of a section with an id of its own are made and
    concatenated in its row, without a shuffle; only the tokens of section ids that several rows have are grouped."""
    again = repeated_sections(index.sections)
    words = index.words if again is None else sections_once(index.words, again)
    once = tsvectors_of(words, stop_words(index.analysis["stop"]), "none").select(
        "section_id", F.flatten(F.transform("tsv", lambda e: e["positions"])).alias("offsets"))
    if again is None:
        return once
    grouped = T.postings(sections_again(index.tokens, again)).groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "offsets"))).alias("e"))
    return once.unionByName(grouped.select("section_id", F.flatten(F.transform("e", lambda e: e["offsets"])).alias("offsets")))


def vector_stats(vectors: DataFrame) -> tuple[Column, Column]:
    """D8 from the vectors, which have a row for every section: number of sections and their
    average length, read once."""
    r = rank_vars(vectors).first()
    return F.lit(r["num_secs"]), F.lit(r["avg_sec_len"])


def stems_among(stems: Column, listed: list[str] | None) -> Column:
    """The entries of ``stems`` that a query names (all when there is no list)."""
    if listed is None:
        return stems
    return F.filter(stems, lambda s: s.isin(listed) if listed else F.lit(False))


def named_entries(vectors: DataFrame, listed: list[str] | None) -> DataFrame:
    """The vectors with only the entries whose stem a query names (all when there is no list): what is
    then done for every (query, section) pair costs a query's entries, not the section's."""
    if listed is None:
        return vectors
    at = F.filter(F.transform("stems", lambda s, i: F.when(s.isin(listed) if listed else F.lit(False), i)),
                  lambda i: i.isNotNull())

    def entries(c: str) -> Column:
        return F.transform("__at", lambda i: F.get(F.col(c), i)).alias(c)

    arrays = ("terms", "stems", "offsets", "frequencies")
    return vectors.withColumn("__at", at).filter(F.size("__at") > 0).select(
        *[entries(c) if c in arrays else F.col(c) for c in vectors.columns])


def idf_from_vectors(vectors: DataFrame, num_secs: Column, stems: DataFrame | None = None) -> DataFrame:
    """IDF by unnesting the stem arrays (one entry per surface term, as
    the reference counts).  With ``stems`` only those stems are aggregated."""
    listed = None if stems is None else query_stems(stems)
    e = vectors.select(F.explode(stems_among(F.col("stems"), listed)).alias("stem"), F.lit(1).alias("n_terms"))
    if stems is not None:
        e = e.join(small_side(stems.select("stem").distinct(), bound=stems), "stem", "left_semi")
    return idf_view(e, num_secs, "rows")


# ---------------------------------------------------------------------------
# array helpers
# ---------------------------------------------------------------------------

def vector_tf(stems: Column, freqs: Column, stem: Column) -> Column:
    """P9 getTF: sum of the frequencies at the entries of ``stem``."""
    return F.aggregate(F.filter(freqs, lambda f, i: F.get(stems, i) == stem), F.lit(0),
                       lambda a, f: a + f)


def stem_offsets(stems: Column, offsets: Column, stem: Column) -> Column:
    """Offsets of all entries of ``stem`` merged and sorted."""
    return F.array_sort(F.flatten(F.filter(offsets, lambda o, i: F.get(stems, i) == stem)))


def nested_get(nested: Column, indices: Column) -> Column:
    """P7 getItem: concatenation of the sub-arrays at 1-based ``indices``, in the order of ``nested``.

    ``indices`` is evaluated once a row; inside a lambda it would be once an element."""
    inside = F.filter(F.array_sort(F.array_distinct(indices)), lambda i: (i >= 1) & (i <= F.size(nested)))
    picked = F.flatten(F.transform(inside, lambda i: F.get(nested, i - 1)))
    return F.when(nested.isNotNull(), F.coalesce(picked, F.when(indices.isNull(), F.slice(F.flatten(nested), 1, 0))))


def get_pos(arr: Column, i: Column) -> Column:
    """P8 getPos: 0-based element or null."""
    return F.get(arr, i)


def nested_length(nested: Column) -> Column:
    """P10 length_nested: total number of elements."""
    return F.size(F.flatten(nested))


def query_offsets(stems: Column, offsets: Column, query: Column) -> Column:
    """P6 agg_query_offsets: one merged offset list per query stem present, in
    query order."""
    lists = F.transform(query, lambda q: stem_offsets(stems, offsets, q))
    return F.filter(lists, lambda l: F.size(l) > 0)


def concat_agg(arrays: Column) -> Column:
    """P12 jsonb_concat_agg: concatenation of collected arrays (aggregate)."""
    return F.flatten(F.collect_list(arrays))


# ---------------------------------------------------------------------------
# batch search and ranking on vectors
# ---------------------------------------------------------------------------

def _query_rows(vectors: DataFrame, queries: DataFrame, num_secs: Column, unknown: str):
    q = normalise_queries(queries)
    idf_q = idf_from_vectors(vectors, num_secs, queries)
    if query_stems(queries) is not None:  # a row a listed stem at most: the vectors are read once for them
        from parindex.plans.querytable import local_table
        idf_q = local_table(vectors.sparkSession, [tuple(r) for r in idf_q.collect()],
                            "stem string, df long, idf double, bm25idf double")
    known = idf_q.select("stem", F.lit(True).alias("known"))
    qk = q.join(known, "stem", "left")
    groups = qk.groupBy("query_id", "top_op", "group_id", "group_op").agg(
        F.array_sort(F.collect_set(F.when(F.col("known"), F.col("stem")))).alias("stems"),
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.col("known"), 1)).alias("n_known"))
    ok = (F.col("n_known") > 0) if unknown == "drop" else \
        ((F.col("n_known") > 0) & (F.col("n_known") == F.col("n_total")))
    qdef = groups.groupBy("query_id", "top_op").agg(
        F.collect_list(F.struct("group_op", "stems", ok.alias("ok"), signature(F.col("stems")).alias("signature")))
        .alias("groups"))
    qterms = q.select("query_id", "stem").distinct().join(idf_q, "stem").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("stem", "idf", "bm25idf"))).alias("qterms"))
    return qterms.join(qdef, "query_id")


def vector_candidates(vectors: DataFrame, queries: DataFrame, num_secs: Column,
                      unknown: str = "drop") -> DataFrame:
    """One row per (query, section) sharing a stem, with the query's arrays;
    filtered by the Boolean predicate (Q6–Q8 for any number of groups).

    A section's row, cut to the entries of query stems, meets the broadcast queries through its own stems and
    carries its arrays along; above the broadcast bound only ``(section_id, stem)`` is shuffled and
    the arrays join once per candidate pair."""
    queries = prepare_queries(queries)
    if "signature" not in vectors.columns:
        vectors = vectors.withColumn("signature", signature(F.col("stems")))
    qrow = _query_rows(vectors, queries, num_secs, unknown)
    vectors = named_entries(vectors, query_stems(queries))
    flat = normalise_queries(queries).select("query_id", F.col("stem").alias("__stem")).distinct()
    named = F.explode(F.array_distinct("stems")).alias("__stem")
    shared = F.array_intersect(F.col("stems"), F.transform("qterms", lambda t: t["stem"]))
    matches = boolean_match(F.col("groups"), F.array_distinct(shared), F.col("top_op"))
    may_match = signature_match(F.col("groups"), F.col("signature"), F.col("top_op"))
    if fits_broadcast(queries):
        c = vectors.select("*", named).join(F.broadcast(flat), "__stem").join(F.broadcast(qrow), "query_id")
        c = c.filter(may_match).filter(F.col("__stem") == F.array_min(shared)).drop("__stem")
    else:
        pairs = vectors.select("section_id", named).join(flat, "__stem").select("query_id", "section_id").distinct()
        c = vectors.join(pairs, "section_id").join(qrow, "query_id").filter(may_match)
    return c.filter(matches)


def vector_scores(c: DataFrame, avg: Column, proximity: bool = False,
                  span_mode: str = "intended", k3: float = 1000.0) -> DataFrame:
    """R7–R10 as higher-order functions over one candidate row."""
    stems, freqs, offs = F.col("stems"), F.col("frequencies"), F.col("offsets")
    per = F.transform("qterms", lambda t: F.struct(
        t["stem"].alias("stem"), vector_tf(stems, freqs, t["stem"]).alias("tf"),
        t["idf"].alias("idf"), t["bm25idf"].alias("bm25idf")))
    # scalar subqueries may not appear inside lambdas: attach the average first
    c = c.withColumn("__per", per).withColumn("__avg", avg)
    avg = F.col("__avg")

    def total(fn):
        return F.aggregate(F.transform("__per", fn), F.lit(0.0), lambda a, x: a + x)

    nw = F.col("num_words")
    cols = {
        "tfidf": total(lambda t: S.tfidf_term(t["tf"], t["idf"])),
        "bm25": total(lambda t: S.bm25_term(t["tf"], t["bm25idf"], nw, avg, BM25_K1, BM25_B)),
        "bm25_ext": total(lambda t: F.when(t["tf"] > 0, S.bm25_term(
            t["tf"], t["bm25idf"], nw, avg, BM25_EXT_K1, BM25_EXT_B)).otherwise(F.lit(0.0))),
        "nj": F.aggregate(F.transform("__per", lambda t: t["tf"]), F.lit(0), lambda a, x: a + x),
    }
    c = c.withColumns(cols)
    if proximity:
        present = F.filter("__per", lambda t: t["tf"] > 0)
        lists = F.transform(present, lambda t, i: F.struct(
            i.alias("k"), stem_offsets(stems, offs, t["stem"]).alias("offsets"),
            t["bm25idf"].alias("bm25idf"), t["idf"].alias("idf")))
        c = c.withColumn("lists", lists)
        n = F.size("lists")
        fold = F.when(n >= 2, P.proximity_fold(F.col("lists")))
        c = c.withColumn("__fold", fold).withColumns({
            "min_dist": P.min_dist_sum(F.col("__fold"), n),
            "min_span": P.min_span_score(F.col("__fold"), n, span_mode),
            "prox_bm25": P.bm25_proximity(F.col("__fold"), n,
                                          F.transform("lists", lambda l: l["bm25idf"]), nw, avg, k3=k3),
        }).drop("__fold")
    return c.drop("__per", "__avg")


def vec_rank(vectors: DataFrame, queries: DataFrame, num_secs: Column, avg: Column,
             method: str = "bm25", k: int = 10, unknown: str = "drop",
             span_mode: str = "intended") -> DataFrame:
    from parindex.operators.rank import method_score
    c = vector_candidates(vectors, queries, num_secs, unknown)
    c = vector_scores(c, avg, proximity=method in ("tfidf_ext", "bm25_ext"), span_mode=span_mode)
    scored = c.select("query_id", "section_id", S.rounded(method_score(method)).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")


def vec_rank_methods(vectors: DataFrame, queries: DataFrame, num_secs: Column, avg: Column, methods: tuple[str, ...],
                     k: int = 10, unknown: str = "drop") -> DataFrame:
    """The rankings of several ``methods`` without proximity from one pass over the vectors."""
    c = vector_scores(vector_candidates(vectors, queries, num_secs, unknown), avg)
    return top_k_by(c, methods, k)


def vec_search(vectors: DataFrame, queries: DataFrame, num_secs: Column, unknown: str = "drop") -> DataFrame:
    return vector_candidates(vectors, queries, num_secs, unknown).select("query_id", "section_id")


def bm25_unnest(vectors: DataFrame, queries: DataFrame, num_secs: Column, avg: Column,
                k: int = 10, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 by unnesting the vectors — every section holding any query
    stem is scored (OR semantics), tf summed over the stem's surface terms."""
    queries = prepare_queries(queries)
    q = normalise_queries(queries).select("query_id", "stem").distinct()
    idf_q = idf_from_vectors(vectors, num_secs, queries)
    qs = q.join(idf_q, "stem")
    listed = query_stems(queries)
    wanted = (lambda e: F.lit(True)) if listed is None else (
        lambda e: e["stem"].isin(listed) if listed else F.lit(False))
    z = vectors.select("section_id", "num_words",
                       F.explode(F.filter(F.arrays_zip(F.col("stems").alias("stem"),
                                                       F.col("frequencies").alias("tf")), wanted)).alias("z"))
    z = z.select("section_id", "num_words", "z.stem", "z.tf")
    # placed by (query, section) once: both aggregations then need no further exchange
    j = z.join(small_side(qs, bound=queries), "stem").repartition("query_id", "section_id")
    per = j.groupBy("query_id", "section_id", "stem").agg(
        F.sum("tf").alias("tf"), F.max("num_words").alias("num_words"), F.max("bm25idf").alias("bm25idf"))
    sc = per.groupBy("query_id", "section_id").agg(F.sum(S.bm25_term(
        F.col("tf"), F.col("bm25idf"), F.col("num_words"), avg, k1, b)).alias("score"))
    return top_k(sc.withColumn("score", S.rounded(F.col("score"))), k) \
        .select("query_id", "rank", "section_id", "score")
