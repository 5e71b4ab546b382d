"""Boolean search over postings for a whole table of queries (Q1–Q5, Q11, Q12).

Plan shape for any batch of queries::

    postings ⋈ broadcast(query stems with idf)          (map side, no shuffle)
      -> groupBy(query_id, section_id)                   (one exchange, partial agg)
      -> ⋈ broadcast(query definitions)                  (groups as an array)
      -> filter(top_op over groups, group_op over stems)  (higher-order functions)

The query side is broadcast only after its size is checked
(:func:`small_side`); beyond the limit the planner and AQE choose (shuffle
join with skew splitting).  A stem that is in a third of all sections only
makes the map side longer: the exchange is keyed by section, so no single
task receives all its postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.functions import scoring as S
from parindex.operators.index import (BM25_B, BM25_EXT_B, BM25_EXT_K1, BM25_K1,
                                      TextIndex, add_bucket_like, join_keys)

from parindex.functions.sizing import (MAX_BROADCAST_LOCAL_BYTES, MAX_BROADCAST_QUERY_ROWS,  # noqa: F401
                                      estimated_bytes, is_local, small_side)

# Query tables with at most this many distinct stems get a static stem list
# (and bucket list) pushed into the postings scan.
MAX_PUSHED_STEMS = 5_000


def pushed_stems(queries: DataFrame) -> list[str] | None:
    """The distinct stems of a local query table (None when not local or too
    many): planning-time parameters, like the partition list a dynamic
    pruning filter would produce."""
    if not is_local(queries) or estimated_bytes(queries) > MAX_BROADCAST_LOCAL_BYTES:
        return None
    # a projection of a local relation is folded at planning time: no job
    stems = sorted({r[0] for r in queries.select("stem").collect() if r[0] is not None})
    return stems if len(stems) <= MAX_PUSHED_STEMS else None


def derived_pruning(queries: DataFrame, buckets: int) -> tuple[list[int], list[str] | None]:
    """The buckets (at most the bucket count of the index) and, up to
    ``MAX_PUSHED_STEMS``, the stems of a query table that is not local."""
    from parindex.sources.store import stem_bucket
    known = getattr(queries, "_parindex_pruning", {})
    if buckets not in known:
        stems = queries.select("stem").filter(F.col("stem").isNotNull()).distinct() \
            .withColumn("bucket", stem_bucket(F.col("stem"), buckets))
        counts = stems.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        few = sum(r["n"] for r in counts) <= MAX_PUSHED_STEMS
        known[buckets] = (sorted(r["bucket"] for r in counts),
                          sorted(r["stem"] for r in stems.select("stem").collect()) if few else None)
        queries._parindex_pruning = known
    return known[buckets]


def query_stems(queries: DataFrame) -> list[str] | None:
    """The distinct stems of any query table, None above ``MAX_PUSHED_STEMS``."""
    stems = pushed_stems(queries)
    return derived_pruning(queries, 1)[1] if stems is None else stems


def pruned_postings(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Postings restricted to the query stems at scan time: ``stem IN (…)``
    reaches Parquet (row groups are sorted by stem) and, on a bucketed
    index, ``bucket IN (…)`` prunes the partition folders, whether the query
    table is local or derived from data."""
    p = index.postings
    stems = pushed_stems(queries)
    if "bucket" not in p.columns:
        return p if stems is None else p.filter(F.col("stem").isin(stems) if stems else F.lit(False))
    from parindex.sources.store import buckets_of, stem_bucket
    n = buckets_of(p)
    if stems is None:
        buckets, stems = derived_pruning(queries, n)
    else:
        buckets = sorted({r[0] for r in queries.filter(F.col("stem").isNotNull())
                          .select(stem_bucket(F.col("stem"), n)).collect()})
    p = p.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return p if stems is None else p.filter(F.col("stem").isin(stems) if stems else F.lit(False))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """A query table ready to be used in several branches of one plan: local
    tables are kept (folded at planning time); anything else is normalised
    once and its lineage cut with a reliable checkpoint into the shared
    checkpoint folder, so e.g. query texts are tokenised once, not once per
    branch."""
    if getattr(queries, "_parindex_prepared", False) or is_local(queries):
        return queries
    from parindex.session import checkpoint_dir
    checkpoint_dir(queries.sparkSession)
    q = normalise_queries(queries).checkpoint(eager=True)
    q._parindex_prepared = True
    return q


def normalise_queries(queries: DataFrame) -> DataFrame:
    cols = ["query_id", "top_op", "group_id", "group_op", "stem"]
    q = queries.select(F.col("query_id").cast("int"), F.upper("top_op").alias("top_op"),
                       F.col("group_id").cast("int"), F.upper("group_op").alias("group_op"), "stem")
    return q.select(*cols).distinct()


def local_query_rows(queries: DataFrame) -> list[tuple] | None:
    """The rows of a small local query table, normalised and de-duplicated
    (planning-time parameters; None for anything else)."""
    if not is_local(queries) or estimated_bytes(queries) > MAX_BROADCAST_LOCAL_BYTES:
        return None
    rows = queries.select(F.col("query_id").cast("int"), F.upper("top_op"), F.col("group_id").cast("int"),
                          F.upper("group_op"), "stem").collect()
    uniq = sorted({tuple(r) for r in rows}, key=lambda r: (r[0], r[2], r[4] or ""))
    if len({r[4] for r in uniq}) > MAX_PUSHED_STEMS:
        return None
    return uniq


GROUPS_TYPE = "array<struct<group_op:string,stems:array<string>,ok:boolean,mask:bigint>>"
# per query, the statistics of its known stems in bit order (qidf[qbit])
QIDF_TYPE = "array<struct<qbit:int,idf:double,bm25idf:double>>"
# Up to this many known stems per query the matched stems of a section are a
# 64-bit mask (bit_or in a plain hash aggregate); beyond it, a collected list.
MAX_BITS = 63


def _query_parts_local(index: TextIndex, spark, rows: list[tuple], unknown: str,
                       df_mode: str) -> tuple[DataFrame, DataFrame]:
    """Small query table: resolve known stems and their IDF with one filtered
    scan of the stored term statistics (at most one row per query stem) and
    build the two broadcast sides as local relations."""
    from parindex.plans.querytable import local_table
    stems = sorted({r[4] for r in rows if r[4] is not None})
    idf_rows = index.idf_for_list(stems, df_mode).collect() if stems else []
    idf = {r["stem"]: (r["df"], r["idf"], r["bm25idf"]) for r in idf_rows}
    qs_rows = sorted({(r[0], r[4]) for r in rows if r[4] in idf})
    bit: dict[tuple, int] = {}
    numbered: dict[int, int] = {}
    for q, st in qs_rows:
        bit[(q, st)] = numbered.get(q, 0)
        numbered[q] = bit[(q, st)] + 1
    qs = local_table(spark, [(q, st, *idf[st], bit[(q, st)]) for q, st in qs_rows],
                     "query_id int, stem string, df long, idf double, bm25idf double, qbit int")
    groups: dict[tuple, list] = {}
    for q, top, g, gop, st in rows:
        groups.setdefault((q, top, g, gop), []).append(st)
    per_query: dict[tuple, list] = {}
    for (q, top, g, gop), sts in sorted(groups.items()):
        known = sorted({x for x in sts if x in idf})
        n_total = len(set(sts))
        ok = len(known) > 0 if unknown == "drop" else (len(known) > 0 and len(known) == n_total)
        mask = 0
        for x in known:
            if bit[(q, x)] < MAX_BITS:
                mask |= 1 << bit[(q, x)]
        if mask >= 1 << 63:
            mask -= 1 << 64
        per_query.setdefault((q, top), []).append({"group_op": gop, "stems": known, "ok": ok, "mask": mask})
    qidf: dict[int, list] = {}
    for q, st in qs_rows:
        qidf.setdefault(q, []).append({"qbit": bit[(q, st)], "idf": float(idf[st][1]),
                                       "bm25idf": float(idf[st][2])})
    qdef = local_table(spark, [(q, top, gl, sorted(qidf.get(q, []), key=lambda d: d["qbit"]))
                               for (q, top), gl in sorted(per_query.items())],
                       f"query_id int, top_op string, groups {GROUPS_TYPE}, qidf {QIDF_TYPE}")
    return qs, qdef


def query_parts(index: TextIndex, queries: DataFrame, unknown: str = "drop",
                df_mode: str = "rows") -> tuple[DataFrame, DataFrame]:
    """-> ``qs(query_id, stem, df, idf, bm25idf)`` for known stems, and
    ``qdef(query_id, top_op, groups)`` with ``groups`` an array of
    ``struct(group_op, stems, ok)``.

    ``unknown="drop"``: a group is judged on its known stems (the reference);
    ``"empty"``: a group with an unknown stem cannot match.  A group without
    any known stem never matches."""
    if unknown not in ("drop", "empty"):
        raise ValueError(f"unknown must be 'drop' or 'empty', not {unknown!r}")
    queries = prepare_queries(queries)
    local = local_query_rows(queries)
    if local is not None:
        return _query_parts_local(index, queries.sparkSession, local, unknown, df_mode)
    q = normalise_queries(queries)
    idf_q = index.idf_for(q, df_mode)
    # bit index of each known stem inside its query (window over the query
    # table only, partitioned by query)
    from pyspark.sql.window import Window
    qs = q.select("query_id", "stem").distinct().join(idf_q, "stem")
    qs = qs.withColumn("qbit", (F.row_number().over(Window.partitionBy("query_id").orderBy("stem")) - 1)
                       .cast("int"))
    known = qs.select("query_id", "stem", F.lit(True).alias("known"), "qbit")
    qk = q.join(known, ["query_id", "stem"], "left")
    bitval = F.when(F.col("known") & (F.col("qbit") < MAX_BITS),
                    F.expr("shiftleft(CAST(1 AS BIGINT), qbit)")).otherwise(F.lit(0).cast("long"))
    groups = qk.groupBy("query_id", "top_op", "group_id", "group_op").agg(
        F.array_sort(F.collect_set(F.when(F.col("known"), F.col("stem")))).alias("stems"),
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.col("known"), 1)).alias("n_known"),
        F.bit_or(bitval).alias("mask"))
    if unknown == "drop":
        ok = F.col("n_known") > 0
    elif unknown == "empty":
        ok = (F.col("n_known") > 0) & (F.col("n_known") == F.col("n_total"))
    else:
        raise ValueError(f"unknown must be 'drop' or 'empty', not {unknown!r}")
    qdef = groups.groupBy("query_id", "top_op").agg(
        F.collect_list(F.struct("group_op", "stems", ok.alias("ok"), "mask")).alias("groups"))
    qidf = qs.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("qbit", F.col("idf").cast("double").alias("idf"),
                 F.col("bm25idf").cast("double").alias("bm25idf")))).alias("qidf"))
    qdef = qdef.join(qidf, "query_id", "left")
    return qs, qdef


def max_stems_per_query(queries: DataFrame) -> int:
    """Largest number of distinct stems in one query (planning-time check of
    the query table; no job for a local table)."""
    local = local_query_rows(queries)
    if local is not None:
        per: dict[int, set] = {}
        for r in local:
            per.setdefault(r[0], set()).add(r[4])
        return max((len(v) for v in per.values()), default=0)
    if not hasattr(queries, "_parindex_max_stems"):  # asked by every pass over a batch
        queries._parindex_max_stems = int(normalise_queries(queries).groupBy("query_id").agg(
            F.count_distinct("stem").alias("n")).agg(F.max("n")).first()[0] or 0)
    return queries._parindex_max_stems


def boolean_match_bits(groups: Column, bits: Column, top_op: Column) -> Column:
    """As :func:`boolean_match` with the matched stems as a bit mask."""
    def group_ok(g):
        hit = bits.bitwiseAND(g["mask"])
        return g["ok"] & F.when(g["group_op"] == "AND", hit == g["mask"]).otherwise(hit != 0)
    return F.when(top_op == "AND", F.forall(groups, group_ok)).otherwise(F.exists(groups, group_ok))


def boolean_match(groups: Column, matched: Column, top_op: Column) -> Column:
    """Top-level AND/OR over groups, group-level AND/OR over stems."""
    def group_ok(g):
        has = lambda s: F.array_contains(matched, s)
        return g["ok"] & F.when(g["group_op"] == "AND", F.forall(g["stems"], has)) \
            .otherwise(F.exists(g["stems"], has))
    return F.when(top_op == "AND", F.forall(groups, group_ok)).otherwise(F.exists(groups, group_ok))


def scored_hits(index: TextIndex, queries: DataFrame, unknown: str = "drop",
                df_mode: str = "rows", with_offsets: bool = False,
                scores: tuple[str, ...] = ("tfidf", "bm25", "bm25_ext"),
                bm25_k1: float = BM25_K1, bm25_b: float = BM25_B,
                restrict: DataFrame | None = None,
                parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Matching (query, section) pairs with the aggregates every ranking needs.

    Columns: ``query_id, section_id, num_words, nj, matched`` plus the requested
    partial scores and, with ``with_offsets``, ``lists`` =
    array<struct<stem, offsets, bm25idf, idf>> for proximity.

    ``restrict``: the only (query, section) pairs asked for, broadcast by the caller if
    small.  ``parts``: the query's parts where the caller has them; with a column ``essential``
    in the stems, hits without an essential stem are left out."""
    queries = prepare_queries(queries)
    qs, qdef = query_parts(index, queries, unknown, df_mode) if parts is None else parts
    avg = index.avg_sec_len()
    qs = add_bucket_like(index.postings, qs)
    p = pruned_postings(index, queries).join(small_side(qs, bound=queries), join_keys(index.postings))
    if restrict is not None:
        # only these (query, section) pairs go on (semi join before the
        # aggregation, so nothing else is collected)
        p = p.join(restrict, ["query_id", "section_id"], "left_semi")
    max_stems = max_stems_per_query(queries)
    use_bits = max_stems <= MAX_BITS
    bm25 = S.bm25_term(F.col("tf"), F.col("bm25idf"), F.col("num_words"), avg, bm25_k1, bm25_b)
    bm25_ext = S.bm25_term(F.col("tf"), F.col("bm25idf"), F.col("num_words"), avg, BM25_EXT_K1, BM25_EXT_B)
    # only (bit number, offsets) travel through the aggregation; the stem's
    # statistics are re-attached from the broadcast query definitions
    entry = F.struct("qbit", "offsets")
    # (a batch of one-term queries could skip this aggregation, but measured
    # slower: the aggregation's exchange also balances the top-k sort)
    matched = (F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), qbit)")).alias("matched_bits")
               if use_bits else F.collect_list("stem").alias("matched"))
    aggs = [matched,
            F.sum("tf").cast("long").alias("nj"),
            F.max("num_words").alias("num_words")]
    if "tfidf" in scores:
        aggs.append(F.sum(S.tfidf_term(F.col("tf"), F.col("idf"))).alias("tfidf"))
    if "bm25" in scores:
        aggs.append(F.sum(bm25).alias("bm25"))
    if "bm25_ext" in scores:
        aggs.append(F.sum(bm25_ext).alias("bm25_ext"))
    if "freq" in scores:
        aggs.append(F.sum(S.freq_term(F.col("tf"))).alias("freq"))
    if with_offsets:
        aggs.append(F.collect_list(entry).alias("lists"))
    if "essential" in qs.columns:
        aggs.append(F.bool_or("essential").alias("essential"))
    h = p.groupBy("query_id", "section_id").agg(*aggs)
    if "essential" in qs.columns:
        h = h.filter("essential").drop("essential")
    h = h.join(small_side(qdef, bound=queries), "query_id")
    keep = (boolean_match_bits(F.col("groups"), F.col("matched_bits"), F.col("top_op")) if use_bits
            else boolean_match(F.col("groups"), F.col("matched"), F.col("top_op")))
    h = h.filter(keep).withColumn(
        "n_present", F.bit_count("matched_bits") if use_bits else F.size("matched"))
    if with_offsets:
        h = h.withColumn("lists", F.transform(F.array_sort("lists"), lambda l: F.struct(
            l["qbit"].alias("qbit"), l["offsets"].alias("offsets"),
            F.get(F.col("qidf"), l["qbit"])["bm25idf"].alias("bm25idf"),
            F.get(F.col("qidf"), l["qbit"])["idf"].alias("idf"))))
    return h.drop("groups", "top_op", "matched_bits", "matched", "qidf")


def search(index: TextIndex, queries: DataFrame, unknown: str = "drop") -> DataFrame:
    """Q1–Q5: ``(query_id, section_id)`` of every matching section."""
    return scored_hits(index, queries, unknown, scores=()).select("query_id", "section_id")


def num_results(index: TextIndex, queries: DataFrame, unknown: str = "drop") -> DataFrame:
    """Q11: number of matching sections per query; queries without hits give 0."""
    queries = prepare_queries(queries)
    counts = search(index, queries, unknown).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("num_results"))
    ids = normalise_queries(queries).select("query_id").distinct()
    return ids.join(counts, "query_id", "left").select(
        "query_id", F.coalesce("num_results", F.lit(0)).cast("long").alias("num_results"))


def passages_by_term(surface: TextIndex, terms: DataFrame) -> DataFrame:
    """Q12 (text key): distinct passages holding each query term, from an index
    whose stems are surface terms: only the terms' buckets and row groups are read."""
    t = terms.select("query_id", F.col("term").alias("stem")).distinct()
    named = add_bucket_like(surface.postings, t)
    hits = pruned_postings(surface, t).join(small_side(named, bound=terms), join_keys(surface.postings))
    return hits.groupBy("query_id").agg(F.count_distinct("section_id").alias("num_passages"))


def passages_by_id(coded_postings: DataFrame, vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Q12 (id key): look the terms up in the dictionary first, then probe the
    coded postings by id (few ids are pushed to the scan)."""
    t = terms.select("query_id", "term").distinct()
    ids = vocab.join(small_side(t, bound=terms), "term").select("query_id", "term_id")
    listed = None
    if is_local(terms):
        names = [r[0] for r in t.select("term").distinct().collect()]
        if len(names) <= MAX_PUSHED_STEMS:
            listed = [r[0] for r in vocab.filter(F.col("term").isin(names)).select("term_id").collect()]
    if listed is not None:
        coded_postings = coded_postings.filter(F.col("term_id").isin(listed) if listed else F.lit(False))
    # vocabulary terms are unique: the ids are at most as many as the terms
    return coded_postings.join(small_side(ids, bound=terms), "term_id") \
        .groupBy("query_id").agg(F.count_distinct("section_id").alias("num_passages"))
