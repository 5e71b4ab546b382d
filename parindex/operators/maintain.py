"""Index maintenance: append, delete, vocabulary clean-up, counts, sampling
(S3, S4, S6, S9, D12–D14).

Statistics are never patched: IDF depends on N, so every change produces a
fresh statistics snapshot computed from the current tables (D12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parindex.functions import text as tx
from parindex.operators import index as D
from parindex.operators import text as T

# Lehmer (MINSTD) step used for the reproducible sample.
_MINSTD_M = 2147483647
_MINSTD_A = 48271


def sample_key(doc_id: Column, seed: int = 0) -> Column:
    """A pseudo-random value in (0, 1) per id — three Lehmer steps from
    ``id + seed + 1``, in integer arithmetic any SQL engine reproduces."""
    x = F.pmod(doc_id + F.lit(seed), F.lit(_MINSTD_M - 1)) + 1
    for _ in range(3):
        x = F.pmod(x * F.lit(_MINSTD_A), F.lit(_MINSTD_M))
    return x / F.lit(float(_MINSTD_M))


def sample(corpus: DataFrame, fraction: float, seed: int = 0, reproducible: bool = True) -> DataFrame:
    """S3: Bernoulli sample of documents.  ``reproducible`` keys the draw on the
    document id (same rows in every run and engine); otherwise ``df.sample``."""
    if not reproducible:
        return corpus.sample(fraction=fraction, seed=seed)
    return corpus.filter(sample_key(F.col("doc_id"), seed) < fraction)


def sample_n(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """S3 by count: the n documents with the smallest draw (a top-n, no sort
    of the whole corpus — Spark's TakeOrderedAndProject)."""
    return corpus.orderBy(sample_key(F.col("doc_id"), seed), "doc_id").limit(n)


def append_docs(index: D.TextIndex, new_corpus: DataFrame, **build_args) -> D.TextIndex:
    """Add documents not yet indexed.  Ids already present are dropped from
    the batch (anti join against the batch's own ids only: the existing
    section table is semi-joined with the small batch first)."""
    from parindex.functions.sizing import small_side
    new_corpus = new_corpus.dropDuplicates(["doc_id"])  # an id twice in the batch is one document
    new_ids = new_corpus.select("doc_id").distinct()
    present = index.sections.select("doc_id").join(small_side(new_ids, bound=new_corpus), "doc_id",
                                                   "left_semi").distinct()
    fresh = new_corpus.join(present, "doc_id", "left_anti")
    add = D.build_index(fresh, **build_args)
    tokens = index.tokens.unionByName(add.tokens) if index.tokens is not None else None
    return D.TextIndex(sections=index.sections.unionByName(add.sections.select(*index.sections.columns)),
                       tokens=tokens,
                       postings=index.postings.unionByName(add.postings.select(*index.postings.columns)))


def delete_docs(index: D.TextIndex, corpus: DataFrame, titles: DataFrame, first_only: bool = False) -> D.TextIndex:
    """Remove documents by title with their sections and postings.
    ``first_only`` removes only the lowest document id per title (the
    reference's behaviour); by default every match goes."""
    docs = corpus.join(titles.select("title").distinct(), "title", "left_semi").select("doc_id", "title")
    if first_only:
        docs = docs.groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    # the ids to delete are broadcast when there are few of them, so a
    # document holding a third of all postings is filtered map-side instead of
    # landing in one task of a shuffle join
    from parindex.functions.sizing import small_side
    ids = docs.select("doc_id").distinct()
    gone = small_side(ids, bound=ids)
    sections = index.sections.join(gone, "doc_id", "left_anti")
    doc_of = T.doc_of_section(F.col("section_id"))
    postings = index.postings.withColumn("doc_id", doc_of).join(gone, "doc_id", "left_anti").drop("doc_id")
    tokens = None
    if index.tokens is not None:
        tokens = index.tokens.withColumn("doc_id", doc_of).join(gone, "doc_id", "left_anti").drop("doc_id")
    return D.TextIndex(sections=sections, tokens=tokens, postings=postings)


def vocab_gc(vocab: DataFrame, stems: DataFrame, term_postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop vocabulary terms without postings, then stems no term uses
    (the safe order: a stem still used by another term stays)."""
    v = vocab.join(term_postings.select("term").distinct(), "term", "left_semi")
    s = stems.join(v.select("stem_id").distinct(), "stem_id", "left_semi")
    return v, s


def index_counts(corpus: DataFrame, index: D.TextIndex, stems: DataFrame | None = None) -> DataFrame:
    """Number of rows per index table (one small union of counts)."""
    parts = [
        corpus.select(F.lit("documents").alias("table_name"), F.lit(1).alias("one")),
        index.sections.select(F.lit("sections").alias("table_name"), F.lit(1).alias("one")),
        index.postings.select(F.lit("postings").alias("table_name"), F.lit(1).alias("one")),
    ]
    if stems is not None:
        parts.append(stems.select(F.lit("stems").alias("table_name"), F.lit(1).alias("one")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("table_name").agg(F.count(F.lit(1)).cast("long").alias("num_rows"))


def content_key(*parts: Column) -> Column:
    """60 bits of the MD5 of an entry's parts joined by ``|``, as any SQL engine makes them."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _offsets(offsets: Column) -> Column:
    return F.array_join(F.transform(offsets, lambda o: o.cast("string")), ",")


def _xor(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def fill_layouts(corpus: DataFrame, path: str, sep: str = "\n", stop: str | list[str] = "nltk") -> DataFrame:
    """Writes every layout of a corpus under ``path`` and returns one row a layout:
    ``(layout, num_rows, checksum)``.

    The text is read and tokenised once, into ``words/`` (per section its words and both lengths);
    from there come ``postings/`` (an index keyed by surface term, in equi-depth ranges),
    ``vectors/`` and ``tsvectors/``.  Rows and checksum (bitwise exclusive or
    of the entries' keys) are observed while a table is written, so nothing is read again
    to count it; postings and vectors hold the same entries, so their checksums agree."""
    from parindex.operators import tsv as C
    from parindex.operators import vector as V
    from parindex.sources import store
    spark = corpus.sparkSession
    seen: list[tuple[str, Observation]] = []

    def watched(layout: str, rows: DataFrame, key: Column) -> DataFrame:
        seen.append((layout, Observation(f"fill-{layout}")))
        return rows.observe(seen[-1][1], F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("checksum"))

    words = T.stored_words(T.split_sections(corpus, sep))
    watched("sections", words, content_key(F.col("section_id"), F.col("num_words"))) \
        .write.mode("overwrite").parquet(f"{path}/words")
    stored = spark.read.schema(words.schema).parquet(f"{path}/words")

    sections = stored.select("section_id", "doc_id", "num_words", D.weight(F.col("num_words")).alias("weight"))
    analysis = {"stop": stop, "lemma_rule": "none"}
    index = D.TextIndex(sections=sections, tokens=None, postings=D.inline_postings(stored, **analysis), words=stored,
                        analysis=analysis)
    store.write_index(index, f"{path}/postings", watch=lambda rows: watched(
        "postings", rows, content_key(F.col("section_id"), F.col("stem"), _offsets(F.col("offsets")))))

    tokens = T.lemmatize(T.positions(stored, stop)).withColumn("num_words", F.lit(0))  # lengths come with the sections
    vectors = V.index_vectors(D.TextIndex(sections=sections, tokens=tokens, postings=index.postings, words=stored,
                                          analysis={"stop": stop, "lemma_rule": "s_stemmer"}))
    entries = F.arrays_zip("terms", "offsets")
    watched("vectors", vectors, _xor(F.transform(entries, lambda e: content_key(
        F.col("section_id"), e["terms"], _offsets(e["offsets"]))))).write.mode("overwrite").parquet(f"{path}/vectors")

    lexemes = C.lexeme_index(index)
    watched("tsvectors", C.tsvector_table(lexemes), _xor(F.transform("tsv", lambda e: content_key(
        F.col("section_id"), e["lexeme"], _offsets(e["positions"]))))).write.mode("overwrite").parquet(f"{path}/tsvectors")
    return spark.createDataFrame([(layout, o.get["n"], o.get["checksum"] or 0) for layout, o in seen],
                                 "layout string, num_rows long, checksum long")
