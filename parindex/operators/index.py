"""Index build, dictionaries and corpus statistics.

Layouts:

* ``sections``  ``(section_id, doc_id, num_words, weight)``       — Section
* ``tokens``    ``(section_id, offset, term, stem, num_words)``   — positioned tokens
* ``postings``  ``(section_id, stem, tf, n_terms, offsets, num_words)`` — one row
  per (section, stem); ``n_terms`` = distinct surface terms of the stem in the
  section, so DF "by rows" (the reference's count of SectionTerm rows) is
  ``sum(n_terms)`` and DF "by sections" is ``count(*)``.
* ``term_postings`` ``(section_id, term, stem, offsets, tf)``     — SectionTerm

``num_words`` is carried on every posting so ranking never joins back to the
section table (no shuffle join against the largest dimension).

Corpus statistics are attached with scalar subqueries (``DataFrame.scalar``):
Catalyst runs the one-row aggregate once and inlines the value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parindex.functions.entries import WORD_RULES, postings_of, stems_of
from parindex.functions.text import stop_words
from parindex.operators import text as T

# Fixed values of the reference's ranking parameters.
BM25_K1 = 1.7
BM25_B = 0.75
BM25_EXT_K1 = 1.2
BM25_EXT_B = 0.9


@dataclass
class TextIndex:
    """Index tables of one corpus.  Built in memory they are lazy plans; read
    from storage they also carry the statistics written with them — the
    document frequencies ``df_table(stem, df_rows, df_sections, max_tf)`` and the one
    row ``stats_table`` — like the reference's materialised views, so queries
    never aggregate the postings for statistics."""

    sections: DataFrame
    tokens: DataFrame | None
    postings: DataFrame
    df_table: DataFrame | None = None
    stats_table: DataFrame | None = None
    # per-section word arrays the sections and tokens were derived from, and
    # how their words become stems (None: by more than a rule); a bulk write
    # counts and writes the postings from them row by row
    words: DataFrame | None = None
    analysis: dict | None = None
    # the postings a bulk write stores, where they are not those of ``words`` row by row
    bulk: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        return self.stats_table if self.stats_table is not None else rank_vars(self.sections)

    def _stored_stat(self, name: str) -> Column | None:
        """Statistics of a stored index are read once (one row) and used as
        literals; an in-memory index keeps scalar subqueries."""
        if self.stats_table is None:
            return None
        if not hasattr(self, "_stat_values"):
            self._stat_values = self.stats_table.first().asDict()
        return F.lit(self._stat_values[name])

    def num_secs(self) -> Column:
        lit = self._stored_stat("num_secs")
        return lit if lit is not None else self.stats.select("num_secs").scalar()

    def avg_sec_len(self) -> Column:
        lit = self._stored_stat("avg_sec_len")
        return lit if lit is not None else self.stats.select("avg_sec_len").scalar()

    def idf_for_list(self, stems: list[str], df_mode: str = "rows") -> DataFrame:
        """IDF rows of a short list of stems (planning-time parameters)."""
        if self.df_table is not None:
            d = self.df_table.filter(F.col("stem").isin(stems))
            return idf_from_df_table(d, self.num_secs(), df_mode)
        p = self.postings.filter(F.col("stem").isin(stems))
        return idf_view(p, self.num_secs(), df_mode)

    def idf(self, df_mode: str = "rows") -> DataFrame:
        if self.df_table is not None:
            return idf_from_df_table(self.df_table, self.num_secs(), df_mode)
        return idf_view(self.postings, self.num_secs(), df_mode)

    def idf_for(self, stems: DataFrame, df_mode: str = "rows") -> DataFrame:
        """IDF of the given (small) set of stems."""
        if self.df_table is not None:
            from parindex.operators.search import pushed_stems
            s = stems.select("stem").distinct()
            d = self.df_table
            listed = pushed_stems(stems)
            if listed is not None:
                d = d.filter(F.col("stem").isin(listed) if listed else F.lit(False))
            from parindex.functions.sizing import small_side
            d = d.join(small_side(s, bound=stems), "stem", "left_semi")
            return idf_from_df_table(d, self.num_secs(), df_mode)
        return idf_for_stems(self.postings, stems, self.num_secs(), df_mode)

    def term_postings(self) -> DataFrame:
        return T.postings(self.tokens)


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, …)`` -> ``(doc_id, title, doc)``."""
    return documents.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("doc"))


def build_sections_and_tokens(corpus: DataFrame | None, sep: str = "\n", stop="nltk",
                              lemma_rule: str = "s_stemmer",
                              lower: bool = True,
                              pieces: DataFrame | None = None,
                              length: str = "words") -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (sections, tokens, words): the per-section word arrays both tables
    are derived from."""
    if pieces is None:
        pieces = T.split_sections(corpus, sep)
    words = T.section_words(pieces, lower, length)
    return *sections_and_tokens(words, stop, lemma_rule), words


def sections_and_tokens(words: DataFrame, stop="nltk", lemma_rule: str = "s_stemmer") -> tuple[DataFrame, DataFrame]:
    """The tables of ``words(section_id, doc_id, words, num_words)``."""
    sections = words.select(
        "section_id", "doc_id", F.col("num_words").cast("int").alias("num_words"),
        weight(F.col("num_words")).alias("weight"))
    # posexplode_outer: with the plain generator Catalyst infers a
    # ``size(words) > 0`` filter and evaluates the tokeniser twice.
    toks = words.select("section_id", "num_words", F.posexplode_outer("words").alias("pos", "term"))
    toks = toks.filter(F.col("term").isNotNull())
    toks = toks.select("section_id", (F.col("pos") + 1).alias("offset"), "term",
                       F.col("num_words").cast("int").alias("num_words"))
    stops = stop_words(stop)
    if stops:
        toks = toks.filter(~F.col("term").isin(stops))
    return sections, T.lemmatize(toks, rule=lemma_rule)


def index_of_words(words: DataFrame, stop="nltk", lemma_rule: str = "s_stemmer") -> TextIndex:
    """As :func:`build_index` for sections whose words are at hand (``T.stored_words``)."""
    sections, toks = sections_and_tokens(words, stop, lemma_rule)
    return TextIndex(sections=sections, tokens=toks, postings=stem_postings(toks), words=words,
                     analysis={"stop": stop, "lemma_rule": lemma_rule})


def build_index(corpus: DataFrame, sep: str = "\n", stop="nltk",
                lemma_rule: str = "s_stemmer", lemma_table: DataFrame | None = None,
                lower: bool = True, postings: str = "aggregate", length: str = "words") -> TextIndex:
    """Corpus -> sections, tokens, postings (all lazy).

    ``postings="aggregate"`` groups the exploded tokens by (section, stem)
    (one exchange, map-side combined); ``"inline"`` builds them inside each
    section's row (no exchange; Arrow batches).  Both give equal tables.
    ``length="blank"`` gives sections the text-search layout's word count."""
    sections, toks, words = build_sections_and_tokens(corpus, sep, stop, lemma_rule, lower, length=length)
    if lemma_table is not None:
        return _table_index(sections, toks, words, stop, lemma_rule, lemma_table)
    if postings == "inline":
        post = inline_postings(words, stop, lemma_rule)
    elif postings == "aggregate":
        post = stem_postings(toks)
    else:
        raise ValueError(f"unknown postings build {postings!r}")
    return TextIndex(sections=sections, tokens=toks, postings=post, words=words,
                     analysis={"stop": stop, "lemma_rule": lemma_rule})


def _table_index(sections: DataFrame, toks: DataFrame, words: DataFrame, stop, lemma_rule: str,
                 lemma_table: DataFrame) -> TextIndex:
    """Index by a supplied lemma table: it meets the distinct terms, they meet the
    postings by surface term (heavy terms without a shuffle), and a section's postings with one
    lemma become one."""
    from parindex.operators.dictionary import attach
    counts = rows_per_stem(words, F.lit(0), stop, "none").select(F.col("stem").alias("term"), "n")
    lemmas = T.lemma_dictionary(counts, lemma_table, lemma_rule)
    terms = inline_postings(words, stop, "none").withColumnRenamed("stem", "term")
    post = attach(terms, lemmas).groupBy("section_id", "stem").agg(
        F.sum("tf").cast("int").alias("tf"), F.count(F.lit(1)).cast("int").alias("n_terms"),
        F.array_sort(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.max("num_words").alias("num_words"))
    return TextIndex(sections=sections, tokens=attach(toks.drop("stem"), lemmas), postings=post, words=words)


def build_index_from_sections(pieces: DataFrame, stop="nltk", lemma_rule: str = "s_stemmer",
                              lemma_table: DataFrame | None = None, lower: bool = True) -> TextIndex:
    """Index of a corpus that is already cut into sections
    ``(section_id, doc_id, para_idx, section)`` — e.g. conversation turns."""
    sections, toks, words = build_sections_and_tokens(None, stop=stop, lemma_rule=lemma_rule, lower=lower, pieces=pieces)
    if lemma_table is not None:
        return _table_index(sections, toks, words, stop, lemma_rule, lemma_table)
    return TextIndex(sections=sections, tokens=toks, postings=stem_postings(toks), words=words,
                     analysis={"stop": stop, "lemma_rule": lemma_rule})


def weight(num_words: Column) -> Column:
    """1/sqrt(num_words), 0 for a section without words."""
    return F.when(num_words == 0, F.lit(0.0)).otherwise(1.0 / F.sqrt(num_words.cast("double")))


def stem_postings(tokens: DataFrame) -> DataFrame:
    """Postings per (section, stem).  Map-side partial aggregation collapses a
    section inside its task, so the exchange carries one row per posting."""
    return (tokens.groupBy("section_id", "stem")
            .agg(F.count(F.lit(1)).cast("int").alias("tf"),
                 # size(collect_set) rather than count(distinct): a distinct
                 # aggregate would add a second exchange keyed by the term
                 F.size(F.collect_set("term")).cast("int").alias("n_terms"),
                 F.array_sort(F.collect_list("offset")).alias("offsets"),
                 F.max("num_words").alias("num_words")))


def rank_vars(sections: DataFrame) -> DataFrame:
    """One row of corpus statistics."""
    return sections.agg(
        F.count(F.lit(1)).alias("num_secs"),
        F.sum("num_words").alias("num_words_secs"),
        F.avg("num_words").alias("avg_sec_len"))


def idf_columns(df: Column, num_secs: Column) -> list[Column]:
    n = num_secs.cast("double")
    d = df.cast("double")
    return [F.log10(n / d).alias("idf"),
            F.log10(1.0 + (n - d + 0.5) / (d + 0.5)).alias("bm25idf")]


def document_frequency(postings: DataFrame, df_mode: str = "rows") -> DataFrame:
    if df_mode == "rows":
        agg = F.sum("n_terms")
    elif df_mode == "sections":
        agg = F.count(F.lit(1))
    else:
        raise ValueError(f"unknown df_mode {df_mode!r}")
    return postings.groupBy("stem").agg(agg.cast("long").alias("df"))


def df_table(postings: DataFrame) -> DataFrame:
    """Both document-frequency variants per stem (stored with the index)."""
    return postings.groupBy("stem").agg(F.sum("n_terms").cast("long").alias("df_rows"),
                                        F.count(F.lit(1)).cast("long").alias("df_sections"))


def term_table(postings: DataFrame) -> DataFrame:
    """The document frequencies with the greatest tf per stem, from which ``operators.bounds``
    knows a stem's greatest partial score."""
    return postings.groupBy("stem").agg(F.sum("n_terms").cast("long").alias("df_rows"),
                                        F.count(F.lit(1)).cast("long").alias("df_sections"),
                                        F.max("tf").alias("max_tf"))


def rows_per_stem(words: DataFrame, block: Column, stop="nltk", lemma_rule: str = "s_stemmer") -> DataFrame:
    """``(stem, block, n)``: (section, term) rows per stem and block of sections,
    without building postings; terms are counted before they are shuffled and stemmed once a block."""
    terms = words.select(block.cast("int").alias("block"), F.explode(F.array_distinct("words")).alias("term"))
    stops = stop_words(stop)
    if stops:
        terms = terms.filter(~F.col("term").isin(stops))
    counted = terms.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"))
    return stems_of(counted, known_rule(lemma_rule)).groupBy("stem", "block").agg(F.sum("n").alias("n"))


def idf_from_df_table(dft: DataFrame, num_secs: Column, df_mode: str = "rows") -> DataFrame:
    col = {"rows": "df_rows", "sections": "df_sections"}[df_mode]
    return dft.select("stem", F.col(col).alias("df"), *idf_columns(F.col(col), num_secs))


def idf_view(postings: DataFrame, num_secs: Column, df_mode: str = "rows") -> DataFrame:
    """``(stem, df, idf, bm25idf)`` with base-10 logarithms.

    ``df_mode="rows"`` counts (section, surface term) rows as the reference's
    SectionTerm does; ``"sections"`` counts distinct sections."""
    d = document_frequency(postings, df_mode)
    return d.select("stem", "df", *idf_columns(F.col("df"), num_secs))


def idf_for_stems(postings: DataFrame, stems: DataFrame, num_secs: Column,
                  df_mode: str = "rows") -> DataFrame:
    """IDF of the given stems only: the postings are semi-joined with the
    (broadcast) stem list before aggregating, so a query batch never aggregates
    the whole vocabulary.  ``stems`` must be small (a query table)."""
    s = stems.select("stem").distinct()
    keys = join_keys(postings, s)
    from parindex.functions.sizing import small_side
    p = postings.join(small_side(add_bucket_like(postings, s), bound=stems), keys, "left_semi")
    return idf_view(p, num_secs, df_mode)


def join_keys(postings: DataFrame, side: DataFrame | None = None) -> list[str]:
    """Join on (bucket, stem) when the postings are stored in stem buckets, so
    that the scan is pruned to the query's bucket folders."""
    return ["bucket", "stem"] if "bucket" in postings.columns else ["stem"]


def add_bucket_like(postings: DataFrame, side: DataFrame) -> DataFrame:
    if "bucket" not in postings.columns or "bucket" in side.columns:
        return side
    from parindex.sources.store import buckets_of, stem_bucket
    return side.withColumn("bucket", stem_bucket(F.col("stem"), buckets_of(postings)))


# ---------------------------------------------------------------------------
# Dictionaries
# ---------------------------------------------------------------------------

def dense_ids(values: DataFrame, col: str, id_col: str, num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based ids in sorted order without an un-partitioned window.

    Range-partition the distinct values, sort within partitions, count rows per
    partition (a handful of numbers), prefix-sum those counts and add the row's
    index inside its partition (``monotonically_increasing_id`` holds it in the
    low 33 bits)."""
    d = values.select(col).distinct()
    if num_partitions:
        d = d.repartitionByRange(num_partitions, col)
    else:
        d = d.repartitionByRange(col)
    d = d.sortWithinPartitions(col).select(
        col, F.spark_partition_id().alias("__pid"),
        F.monotonically_increasing_id().alias("__mid"))
    counts = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    from parindex.functions.sizing import per_partition
    return (d.join(per_partition(offsets), "__pid")
            .select(col, (F.col("__off") + (F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)) + 1)
                    .alias(id_col)))


def stem_dict(tokens: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(stem_id, stem)``.  With an existing dictionary the new stems are
    the anti-join and get ids after the current maximum (upsert, ``ON CONFLICT
    DO NOTHING``)."""
    stems = tokens.select("stem").distinct()
    if existing is None:
        return dense_ids(stems, "stem", "stem_id").select("stem_id", "stem")
    new = stems.join(existing.select("stem"), "stem", "left_anti")
    base = existing.agg(F.coalesce(F.max("stem_id"), F.lit(0)).alias("m")).scalar()
    fresh = dense_ids(new, "stem", "__i").select((F.col("__i") + base).alias("stem_id"), "stem")
    return existing.select("stem_id", "stem").unionByName(fresh)


def vocabulary(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """``(term_id, term, stem_id)``: each term keeps the stem of its first
    writer — the first section, and within it the last occurrence."""
    first = tokens.groupBy("term").agg(
        F.min_by("stem", F.struct(F.col("section_id"), (-F.col("offset")).alias("o"))).alias("stem"))
    with_stem = first.join(stems, "stem")
    ids = dense_ids(first, "term", "term_id")
    return ids.join(with_stem, "term").select("term_id", "term", "stem_id")


def document_table(corpus: DataFrame, sections: DataFrame) -> DataFrame:
    """D3: ``(doc_id, title, num_sections)``; documents without sections keep 0."""
    counts = sections.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_sections"))
    return corpus.select("doc_id", "title").join(counts, "doc_id", "left") \
        .select("doc_id", "title", F.coalesce("num_sections", F.lit(0)).alias("num_sections"))


def lookup_terms(queries: DataFrame, stems: DataFrame, analyze: bool = False,
                 lemma_rule: str = "s_stemmer") -> DataFrame:
    """Query terms -> stem ids; unknown terms drop out (inner join).

    The query side is small and broadcast; the dictionary is not."""
    q = queries
    if analyze:
        q = q.withColumn("stem", T.lemma_column(F.lower(F.col("stem")), lemma_rule))
    from parindex.functions.sizing import small_side
    return stems.join(small_side(q), "stem")


def encode_postings(term_postings: DataFrame, vocab: DataFrame, id_type: str = "long",
                    counts: DataFrame | None = None) -> DataFrame:
    """Text postings -> dictionary-coded postings (``int`` or ``long`` ids).

    ``counts(term, n)``: postings per term, counted here when not given; heavy
    terms meet their ids without a shuffle (``dictionary.attach``)."""
    from parindex.operators.dictionary import attach
    if counts is None:
        counts = term_postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ids = vocab.select("term", F.col("term_id").cast(id_type).alias("term_id"),
                       F.col("stem_id").cast(id_type).alias("stem_id")).join(counts.select("term", "n"), "term")
    return attach(term_postings.select("term", "section_id", "offsets", "tf"), ids).select(
        "section_id", "term_id", "stem_id", "offsets", "tf")


def inline_postings(words: DataFrame, stop="nltk", lemma_rule: str = "s_stemmer") -> DataFrame:
    """Postings per (section, stem) of each section's row, with no
    aggregation and no shuffle: an Arrow batch's words are sorted by (section,
    stem) and each run becomes one posting (tf = run length, sorted offsets, distinct
    surface terms).  Cost O(n log n) per batch; output keeps the input's
    partitioning.  Equal to :func:`stem_postings` over the exploded tokens."""
    return postings_of(words, stop_words(stop), known_rule(lemma_rule))


def known_rule(lemma_rule: str) -> str:
    if lemma_rule not in WORD_RULES:
        raise ValueError(f"unknown lemma rule {lemma_rule!r}")
    return lemma_rule


def repeated_sections(sections: DataFrame) -> DataFrame | None:
    """Section ids that several rows of ``sections`` have (documents that come twice), ready to be
    joined; None where every section has an id of its own."""
    ids = sections.groupBy("section_id").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) | F.col("section_id").isNull()).select(F.col("section_id").alias("__again"))
    if ids.isEmpty():
        return None
    from parindex.functions.sizing import small_side
    return small_side(ids)


def sections_once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    return rows.filter(F.col("section_id").isNotNull()).join(repeated, F.col("section_id") == F.col("__again"), "left_anti")


def sections_again(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of repeated sections, and those without a section id."""
    return rows.join(repeated, F.col("section_id").eqNullSafe(F.col("__again")), "left_semi")
