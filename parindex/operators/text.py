"""Text preparation: corpus -> sections -> positioned tokens.

One narrow job per section: ``split``/``posexplode`` into sections, then
``translate`` + ``regexp_extract_all`` + an array ``filter`` and one
``posexplode`` into tokens.  Nothing leaves the JVM and nothing shuffles until
tokens are grouped into postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.functions import text as tx
from parindex.operators.dictionary import attach
from parindex.session import checkpoint_dir

# section_id = doc_id * 2^20 + piece index: order-preserving, computed in place.
SECTION_BITS = 20


def section_id(doc_id: Column, para_idx: Column) -> Column:
    """The id of a piece; a piece index or document id that does not fit is an
    error, so ids of two documents never meet."""
    doc, limit = doc_id.cast("long"), 1 << (63 - SECTION_BITS)
    fits = (para_idx < F.lit(1 << SECTION_BITS)) & (doc.isNull() | doc.between(-limit, limit - 1))
    return F.when(fits, doc * F.lit(1 << SECTION_BITS) + para_idx).otherwise(
        F.raise_error(F.lit("document id or piece index too large for a section id")).cast("long")).alias("section_id")


def doc_of_section(section: Column) -> Column:
    return F.shiftright(section, SECTION_BITS)


def split_sections(corpus: DataFrame, sep: str = "\n", keep_empty: bool = False) -> DataFrame:
    """``(doc_id, doc)`` -> ``(section_id, doc_id, para_idx, section)``.

    Pieces equal to ``""`` are dropped (the reference keeps only non-empty
    paragraphs as sections); ``keep_empty=True`` keeps every piece, which is what
    the text-search layout counts as its number of sections.
    """
    pieces = corpus.select(
        "doc_id",
        F.posexplode(F.split(F.col("doc"), F.lit("\\Q" + sep + "\\E"), -1)).alias("para_idx", "section"),
    )
    if not keep_empty:
        pieces = pieces.filter(F.col("section") != "")
    return pieces.select(section_id(F.col("doc_id"), F.col("para_idx")), "doc_id", "para_idx", "section")


def section_words(sections: DataFrame, lower: bool = True, length: str = "words") -> DataFrame:
    """T2–T4 on every section: adds ``words`` (array) and ``num_words``.

    ``num_words`` counts words and stop words, not punctuation (pipeline 0);
    ``length="blank"`` counts the parts between single blanks (T14).
    """
    words = tx.word_array(F.col("section"), lower)
    if length == "blank":
        return sections.select("section_id", "doc_id", words.alias("words"),
                               F.size(F.split("section", " ", -1)).alias("num_words"))
    if length != "words":
        raise ValueError(f"unknown length {length!r}")
    return sections.select("section_id", "doc_id", words.alias("words")).withColumn(
        "num_words", F.size("words"))


def stored_words(sections: DataFrame) -> DataFrame:
    """T2–T4 for storage: the words of every section and both its lengths, from which each layout is made."""
    return sections.select(
        "section_id", "doc_id", tx.word_array(F.col("section"), True).alias("words"),
        F.size(F.split("section", " ", -1)).alias("num_words_blank")).withColumn("num_words", F.size("words"))


def positions(words: DataFrame, stop: str | list[str] = "nltk") -> DataFrame:
    """``(section_id, offset, term)`` with 1-based offsets; stop words are
    removed after numbering so their slots stay as gaps."""
    toks = words.select("section_id", F.posexplode_outer("words").alias("pos", "term"))
    toks = toks.filter(F.col("term").isNotNull()).select("section_id", (F.col("pos") + 1).alias("offset"), "term")
    stops = tx.stop_words(stop)
    if stops:
        toks = toks.filter(~F.col("term").isin(stops))
    return toks


def lemma_column(term: Column, rule: str = "s_stemmer") -> Column:
    if rule == "s_stemmer":
        return tx.s_stem(term)
    if rule == "none":
        return term
    raise ValueError(f"unknown lemma rule {rule!r}")


def lemmatize(tokens: DataFrame, lemma_table: DataFrame | None = None,
              rule: str = "s_stemmer", out: str = "stem") -> DataFrame:
    """Noun lemma per token.  A supplied ``lemma_table(term, lemma)`` wins;
    otherwise the rule (S-stemmer by default) applies.

    The lemma table meets the distinct terms; they, with their counts, meet the tokens
    (``operators.dictionary``): the postings of a heavy term stay where they are.
    """
    if lemma_table is None:
        return tokens.withColumn(out, lemma_column(F.col("term"), rule))
    return attach(tokens, lemma_dictionary(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), lemma_table, rule, out))


def lemma_dictionary(counts: DataFrame, lemma_table: DataFrame, rule: str = "s_stemmer", out: str = "stem") -> DataFrame:
    """``(term, n, out)`` for ``counts(term, n)``, written once."""
    checkpoint_dir(counts.sparkSession)
    lt = lemma_table.select("term", F.col("lemma").alias("__lemma"))
    return counts.join(lt, "term", "left").select("term", "n", F.coalesce(
        F.col("__lemma"), lemma_column(F.col("term"), rule)).alias(out)).checkpoint()


def lemmatize_pos(tokens: DataFrame, tags: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """The first letter of a POS tag (a/r/n/v) picks the lemma class; any
    other tag keeps the token.  ``tags(section_id, offset, tag)`` comes from an
    external tagger, ``lemma_table(term, pos, lemma)`` from a dictionary.

    The dictionary meets the distinct terms, with its lemmas of all classes; they meet the tokens, heavy
    terms by broadcast.  So the tags are joined once, for the result, and not for the counts too."""
    checkpoint_dir(tokens.sparkSession)
    lt = lemma_table.groupBy("term").agg(F.collect_list(F.struct("pos", "lemma")).alias("__lemmas"))
    lemmas = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(lt, "term", "left").checkpoint()
    tg = tags.select("section_id", "offset",
                     F.lower(F.substring("tag", 1, 1)).alias("__p"))
    t = attach(tokens.join(tg, ["section_id", "offset"], "left"), lemmas)
    pos = F.when(F.col("__p").isin("a", "r", "n", "v"), F.col("__p")).otherwise(F.lit(""))
    own = F.transform(F.filter("__lemmas", lambda e: e["pos"] == pos), lambda e: F.coalesce(e["lemma"], F.col("term")))
    return t.withColumn("stem", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array("term")))) \
        .drop("__p", "__lemmas")


def suffix_tags(tokens: DataFrame) -> DataFrame:
    """A stand-in tagger by word ending (``-ly`` adverb, ``-ing``/``-ed`` verb,
    ``-ous``/``-ful``/``-ive``/``-able`` adjective, else noun) so that T8 can be
    exercised without a trained model."""
    t = F.col("term")
    tag = (F.when(t.endswith("ly"), "RB")
           .when(t.endswith("ing") | t.endswith("ed"), "VB")
           .when(t.endswith("ous") | t.endswith("ful") | t.endswith("ive") | t.endswith("able"), "JJ")
           .otherwise("NN"))
    return tokens.select("section_id", "offset", tag.alias("tag"))


def tokens_no_url(sections: DataFrame, stop: str | list[str] = "nltk",
                  count_mode: str = "as_written", clean: bool = True) -> DataFrame:
    """T9 (pipeline 1): stop words, URL-like and e-mail-like tokens are dropped
    but keep their slot.  Tokens are cut at blanks, after the clean-up
    characters (``clean=False``: of the text as it is, where e-mail addresses
    are still whole).  Returns ``(section_id, offset, term, num_words)``;
    ``num_words`` is the last offset + 1 as written (one too many), or the
    number of words with ``count_mode="exact"``."""
    w = sections.select("section_id", tx.blank_words(F.col("section"), clean).alias("words")) \
        .withColumn("num_words", F.size("words"))
    toks = w.select("section_id", "num_words", F.posexplode_outer("words").alias("pos", "term")) \
        .filter(F.col("term").isNotNull())
    stops = tx.stop_words(stop)
    keep = ~(tx.is_url_like(F.col("term")) | tx.is_email_like(F.col("term")))
    if stops:
        keep = keep & ~F.col("term").isin(stops)
    extra = 1 if count_mode == "as_written" else 0
    return toks.filter(keep).select(
        "section_id", (F.col("pos") + 1).alias("offset"), "term",
        (F.col("num_words") + extra).alias("num_words"))


def word_sets(tokens: DataFrame) -> DataFrame:
    """Set of terms per section (no offsets)."""
    return tokens.select("section_id", "term").distinct()


def postings(tokens: DataFrame) -> DataFrame:
    """One row per (section, term): sorted offsets and tf.

    The tokens of one section come from one input row, hence from one task, so
    the partial (map-side) aggregation already yields one row per (section,
    term) and the shuffle moves postings, not tokens.
    """
    return (tokens.groupBy("section_id", "term", "stem")
            .agg(F.array_sort(F.collect_list("offset")).alias("offsets"),
                 F.count(F.lit(1)).cast("int").alias("tf")))


def analyzer_chain(sections: DataFrame, protected: DataFrame | None = None,
                   stop: str | list[str] = "nltk", rule: str = "s_stemmer") -> DataFrame:
    """A configurable analyser in the order of the search engine's chain:
    word tokeniser (letters, digits, ``_`` and apostrophes) -> lower case ->
    English possessive (``'s``) removed -> stop words dropped with their slot
    kept -> stem, except for protected words (keyword marker).

    ``protected(term)`` is a small word list joined by broadcast."""
    toks = F.regexp_extract_all(F.lower(F.col("section")), F.lit(r"[\p{L}\p{N}_']+"), 0)
    toks = F.transform(toks, lambda t: F.regexp_replace(t, r"'s$", ""))
    toks = F.filter(toks, lambda t: F.regexp_replace(t, "'", "") != "")
    t = sections.select("section_id", F.posexplode_outer(toks).alias("pos", "term")) \
        .filter(F.col("term").isNotNull()) \
        .select("section_id", (F.col("pos") + 1).alias("offset"), "term")
    stops = tx.stop_words(stop)
    if stops:
        t = t.filter(~F.col("term").isin(stops))
    if protected is None:
        return t.withColumn("stem", lemma_column(F.col("term"), rule))
    p = protected.select(F.col("term").alias("__p")).distinct()
    from parindex.functions.sizing import small_side
    t = t.join(small_side(p), t["term"] == p["__p"], "left")
    return t.withColumn("stem", F.when(F.col("__p").isNotNull(), F.col("term"))
                        .otherwise(lemma_column(F.col("term"), rule))).drop("__p")


def synonym_expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """T15 (query side): every stem of an OR group gains its synonyms as further
    alternatives of the same group.  ``synonyms(stem, alt)`` is a small table
    joined by broadcast; AND groups are left as they are."""
    s = synonyms.select("stem", F.col("alt"))
    from parindex.functions.sizing import small_side
    alts = queries.filter(F.upper("group_op") == "OR").join(small_side(s), "stem") \
        .select("query_id", "top_op", "group_id", "group_op", F.col("alt").alias("stem"))
    return queries.select("query_id", "top_op", "group_id", "group_op", "stem").unionByName(alts).distinct()


def verb_rule(term: Column) -> Column:
    """A verb lemma rule for the T8 lemma table: ``-ing``/``-ed`` removed from
    words long enough to keep a stem of three letters."""
    n = F.length(term)
    return (F.when(term.endswith("ing") & (n > 5), F.substring(term, F.lit(1), n - 3))
            .when(term.endswith("ed") & (n > 4), F.substring(term, F.lit(1), n - 2))
            .otherwise(term))


def rule_lemma_table(tokens: DataFrame) -> DataFrame:
    """``(term, pos, lemma)`` for nouns (S-stemmer) and verbs (``verb_rule``)
    over the distinct vocabulary — a stand-in for a dictionary."""
    v = tokens.select("term").distinct()
    return v.select("term", F.lit("n").alias("pos"), tx.s_stem(F.col("term")).alias("lemma")).unionByName(
        v.select("term", F.lit("v").alias("pos"), verb_rule(F.col("term")).alias("lemma")))
