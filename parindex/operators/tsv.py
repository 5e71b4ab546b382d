"""Text-search layout (the reference's third model): one row per section with
a sorted array of ``struct(lexeme, positions)`` (D7, D11, Q10, R12–R16, P11,
T14).

Definitions that are ours (the reference calls database built-ins whose
formulas are not in it):

* ``rank_freq`` (R12): mean over the query's known lexemes of
  ``sum_{j=1..tf} 1/j^2`` — each further occurrence counts less;
* ``rank_freq_norm`` (R14): flag 1 divides by ``1 + ln(length)``, length = the
  section's number of words;
* ``rank_cover_density`` (R13): over all minimal covers (shortest windows
  holding every query lexeme present), ``1`` for a cover of at most ``K = 16``
  positions, else ``K / length``.  Minimal covers come from the same fold as
  the least span: the shortest window ending at an occurrence is a minimal
  cover exactly when its start moved right since the previous window;
* ``rank_sloppy_phrase`` (R16): all lexemes present (AND), score
  ``1 / (1 + span - (n - 1))`` with ``span`` the least span, 1 for one lexeme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.functions import proximity as P
from parindex.functions import scoring as S
from parindex.functions.entries import tsvectors_of
from parindex.functions.porter import lexemes
from parindex.functions.sizing import is_local
from parindex.functions.text import stop_words
from parindex.operators.dictionary import attach
from parindex.operators.index import TextIndex, inline_postings, repeated_sections, sections_again, sections_once
from parindex.operators.rank import top_k
from parindex.operators.search import pruned_postings, query_parts, scored_hits, small_side
from parindex.operators.index import add_bucket_like, join_keys
from parindex.session import checkpoint_dir

COVER_K = 16


def lexeme_index(surface: TextIndex) -> TextIndex:
    """The text-search model's index: Porter lexemes instead of stems.

    ``surface``: an index whose stems are the surface terms, with its term
    counts.  The stemmer runs on the distinct terms; the lexemes meet the
    postings (not the tokens), heavy terms without a shuffle, and the postings of a
    section's terms with one lexeme become one.

    Where the index still knows its sections' words, the lexemes are made in the section's own row, and
    no posting is shuffled or written before the index itself is."""
    if surface.words is not None and surface.analysis is not None:
        post = _row_postings(surface, surface.analysis["stop"])
        return TextIndex(sections=surface.sections, tokens=None, postings=post, words=surface.words,
                         analysis={"stop": surface.analysis["stop"], "lemma_rule": "porter"}, bulk=post)
    counts = surface.df_table.select(F.col("stem").alias("term"), F.col("df_sections").alias("n"))
    terms = surface.postings.select("section_id", F.col("stem").alias("term"), "tf", "offsets", "num_words")
    checkpoint_dir(counts.sparkSession)
    merged = attach(terms, lexemes(counts).checkpoint()).groupBy("section_id", F.col("lexeme").alias("stem")).agg(
        F.sum("tf").cast("int").alias("tf"), F.count(F.lit(1)).cast("int").alias("n_terms"),
        F.array_sort(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.max("num_words").alias("num_words"))
    return TextIndex(sections=surface.sections, tokens=None, postings=merged)


def _row_postings(index: TextIndex, stop) -> DataFrame:
    """Lexeme postings row by row; section ids that several rows have become one."""
    again = repeated_sections(index.sections)
    if again is None:
        return inline_postings(index.words, stop, "porter")
    return inline_postings(sections_once(index.words, again), stop, "porter").unionByName(
        _merged_postings(sections_again(index.words, again), stop))


def _merged_postings(words: DataFrame, stop) -> DataFrame:
    return inline_postings(words, stop, "porter").groupBy("section_id", "stem").agg(
        F.sum("tf").cast("int").alias("tf"), F.sum("n_terms").cast("int").alias("n_terms"),
        F.array_sort(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.max("num_words").alias("num_words"))


def lexeme_queries(queries: DataFrame) -> DataFrame:
    """A query table (any with a ``stem`` column) whose words are lexemes.

    A local table stays one (its rows are known here); any other is cut from the
    cascade's plan, which would otherwise be optimised again with every join."""
    out = lexemes(queries, "stem", "stem").select(*queries.columns)
    if is_local(queries):
        return queries.sparkSession.createDataFrame(out.collect(), out.schema)
    checkpoint_dir(queries.sparkSession)
    return out.checkpoint()


def tsvector_table(index: TextIndex) -> DataFrame:
    """``(section_id, tsv)`` of a lexeme index — positions merged over a
    lexeme's surface terms; made in the section's row where the index still knows its words."""
    if index.words is not None and index.analysis is not None and index.analysis["lemma_rule"] == "porter":
        stop, again = index.analysis["stop"], repeated_sections(index.sections)
        if again is None:
            return tsvectors_of(index.words, stop_words(stop), "porter")
        return tsvectors_of(sections_once(index.words, again), stop_words(stop), "porter").unionByName(
            _tsvectors(_merged_postings(sections_again(index.words, again), stop)))
    return _tsvectors(index.postings)


def _tsvectors(postings: DataFrame) -> DataFrame:
    return postings.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("stem").alias("lexeme"),
                                             F.col("offsets").alias("positions")))).alias("tsv"))


def num_words_blank(sections_text: DataFrame) -> DataFrame:
    """The text-search model's word count, ``len(text.split(' '))``."""
    return sections_text.select("section_id", F.size(F.split("section", " ", -1)).alias("num_words"))


def term_stats(tsv: DataFrame) -> DataFrame:
    """D11 (``ts_stat``): per lexeme the number of sections and of entries."""
    e = tsv.select("section_id", F.explode("tsv").alias("e"))
    return e.groupBy(F.col("e.lexeme").alias("lexeme")).agg(
        F.count(F.lit(1)).alias("ndoc"), F.sum(F.size("e.positions")).alias("nentry"))


def tsv_offsets(tsv: Column, lexeme: Column) -> Column:
    """Positions of one lexeme (null when absent)."""
    return F.get(F.filter(tsv, lambda x: x["lexeme"] == lexeme), 0)["positions"]


def match_not(index: TextIndex, queries: DataFrame, negated: DataFrame) -> DataFrame:
    """Q10 ``!``: hits of the positive query minus sections holding any
    negated lexeme of the same query (``negated(query_id, stem)``); anti join
    keyed by (query, section), the negated postings semi-joined first."""
    hits = scored_hits(index, queries, scores=()).select("query_id", "section_id")
    neg = add_bucket_like(index.postings, negated.select(F.col("query_id").cast("int"), "stem").distinct())
    bad = pruned_postings(index, neg).join(small_side(neg), join_keys(index.postings)).select("query_id", "section_id")
    return hits.join(bad, ["query_id", "section_id"], "left_anti")


def match_phrase(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """Q10 ``<N>``: sections where the lexemes of a phrase follow each other at
    the given distances.  ``phrases(query_id, step, stem, dist)``: step 0 is
    the first lexeme, step i must sit ``dist`` positions after step i-1.

    Candidates are the sections holding every lexeme (one exchange); the
    position test is a fold over the steps inside the row: the set of
    possible phrase-end positions is carried forward and shifted."""
    return phrase_hits(index, phrases, ["query_id"])


def phrase_hits(index: TextIndex, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """Sections per phrase (``keys`` name a phrase); several stems at one step
    are alternatives."""
    p = phrases.select(*[F.col(c).cast("int").alias(c) for c in keys], F.col("step").cast("int").alias("step"),
                       "stem", F.col("dist").cast("int").alias("dist")).distinct()
    n_steps = p.groupBy(*keys).agg(F.count_distinct("step").alias("n_steps"))
    ps = add_bucket_like(index.postings, p)
    j = pruned_postings(index, phrases).join(small_side(ps, bound=phrases), join_keys(index.postings))
    g = j.groupBy(*keys, "section_id").agg(F.collect_list(F.struct("step", "dist", "offsets")).alias("found"))
    g = g.join(small_side(n_steps, bound=phrases), keys)
    found = F.col("found")
    g = g.filter(F.size(F.array_distinct(found["step"])) == F.col("n_steps"))

    def places(i):
        return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda s: s["step"] == i),
                                                      lambda s: s["offsets"])))

    def shifted(acc, i):
        dist = F.get(F.filter(found, lambda s: s["step"] == i), 0)["dist"]
        return F.array_intersect(places(i), F.transform(acc, lambda q: q + dist))

    # the fold starts at step 0; later steps shift what is left of it
    ends = F.aggregate(F.filter(F.sequence(F.lit(0), (F.col("n_steps") - 1).cast("int")), lambda i: i > 0),
                       places(F.lit(0)), shifted)
    return g.filter(F.size(ends) > 0).select(*keys, "section_id")


#: one row per stem: a query is an AND of clauses, a clause an OR of literals, a
#: literal a phrase (one step: a word), negated or not; stems of a step are alternatives
EXPRESSION_SCHEMA = ("query_id int, clause int, literal int, negated boolean, step int, stem string, dist int")


def match_expression(index: TextIndex, expressions: DataFrame) -> DataFrame:
    """Q10: AND, OR, NOT and followed-by together (``EXPRESSION_SCHEMA``).

    The literals found in a section (one exchange each for phrases and
    sections) decide its clauses.  An expression that holds where nothing is
    found, such as a pure NOT, is answered from the sections table: every
    section except those whose findings break it."""
    keys = ["query_id", "clause", "literal"]
    lits = expressions.select(*[F.col(c).cast("int").alias(c) for c in keys], "negated").distinct()
    clauses = lits.groupBy("query_id", "clause").agg(
        F.collect_list(F.struct("literal", "negated")).alias("lits"))
    qdef = clauses.groupBy("query_id").agg(F.collect_list(F.struct("clause", "lits")).alias("clauses"))
    found = phrase_hits(index, expressions, keys).groupBy("query_id", "section_id").agg(
        F.collect_set(F.struct("clause", "literal")).alias("hit"))
    found = found.join(small_side(qdef, bound=expressions), "query_id")
    holds = F.forall("clauses", lambda c: F.exists(c["lits"], lambda x: F.array_contains(
        F.col("hit"), F.struct(c["clause"].alias("clause"), x["literal"].alias("literal"))) != x["negated"]))
    hits = found.filter(holds).select("query_id", "section_id")
    everywhere = [r[0] for r in qdef.filter(F.forall("clauses", lambda c: F.exists(
        c["lits"], lambda x: x["negated"]))).select("query_id").collect()]
    if not everywhere:
        return hits
    ids = F.array(*[F.lit(q).cast("int") for q in sorted(everywhere)])
    rest = index.sections.select(F.explode(ids).alias("query_id"), "section_id") \
        .join(found.select("query_id", "section_id"), ["query_id", "section_id"], "left_anti")
    return hits.unionByName(rest)


def _tsv_hits(index: TextIndex, queries: DataFrame, unknown: str = "drop") -> DataFrame:
    h = scored_hits(index, queries, unknown, "sections", with_offsets=True, scores=())
    from parindex.operators.rank import with_lists_index
    return with_lists_index(h)


def rank_freq(index: TextIndex, queries: DataFrame, k: int = 10, norm: int = 0) -> DataFrame:
    """R12/R14 for a batch of queries: a plain sum over the frequencies (no
    positions); lexemes a section lacks add 0 to the mean."""
    qs, _ = query_parts(index, queries, "drop", "sections")
    nq = qs.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    h = scored_hits(index, queries, "drop", "sections", scores=("freq",)) \
        .join(small_side(nq, bound=queries), "query_id")
    score = S.length_norm(F.col("freq") / F.col("nq"), F.col("num_words"), norm)
    scored = h.select("query_id", "section_id", F.round(score, 6).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")


def cover_fold(lists: Column) -> Column:
    """Fold over position-sorted occurrences: ``last`` per list, start of the
    previous shortest window and the cover-density sum."""
    n = F.size(lists)
    init = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("prev"),
                    F.lit(0.0).alias("cd"))

    def step(acc, x):
        new_last = F.transform(acc["last"], lambda v, i: F.when(i == x["k"], x["p"]).otherwise(v))
        full = F.forall(new_last, lambda v: v >= 0)
        start = F.array_min(new_last)
        minimal = full & (start > acc["prev"])
        length = (x["p"] - start + 1).cast("double")
        add = F.when(minimal, F.when(length <= COVER_K, F.lit(1.0)).otherwise(F.lit(float(COVER_K)) / length)) \
            .otherwise(F.lit(0.0))
        return F.struct(new_last.alias("last"), F.when(full, start).otherwise(acc["prev"]).alias("prev"),
                        (acc["cd"] + add).alias("cd"))

    return F.aggregate(P.occurrences(lists), init, step)["cd"]


def rank_cover_density(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """R13 for a batch of queries."""
    h = _tsv_hits(index, queries)
    scored = h.select("query_id", "section_id", F.round(cover_fold(F.col("lists")), 6).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")


def rank_sloppy_phrase(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """All query lexemes present, score by least span."""
    from parindex.operators.search import normalise_queries
    nq = normalise_queries(queries).select("query_id", "stem").distinct() \
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    h = _tsv_hits(index, queries).join(small_side(nq, bound=queries), "query_id")
    h = h.filter(F.size("lists") == F.col("nq"))
    n = F.size("lists")
    fold = P.proximity_fold(F.col("lists"))
    span = P.least_span(fold, n)
    score = F.when(n < 2, F.lit(1.0)).otherwise(1.0 / (1.0 + span - (n - 1)))
    scored = h.select("query_id", "section_id", F.round(score, 6).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "section_id", "score")
