"""Score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def tfidf_term(tf: Column, idf: Column) -> Column:
    """(1 + log10 tf) * idf; a stem absent from the section (tf 0) adds 0."""
    return F.when(tf > 0, (1.0 + F.log10(tf.cast("double"))) * idf).otherwise(F.lit(0.0))


def bm25_term(tf: Column, bm25idf: Column, num_words: Column, avg_len: Column,
              k1: float, b: float) -> Column:
    """((k1+1) tf) / (k1((1-b) + b len/avg) + tf) * bm25idf."""
    tfd = tf.cast("double")
    norm = F.lit(k1) * ((1.0 - b) + b * (num_words.cast("double") / avg_len))
    return ((k1 + 1.0) * tfd) / (norm + tfd) * bm25idf


def truncate(score: Column, digits: int = 3) -> Column:
    """Truncate towards zero to ``digits`` decimals."""
    step = float(10 ** digits)
    return F.when(score >= 0, F.floor(score * step)).otherwise(F.ceil(score * step)) / step


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(score, digits)


def freq_term(tf: Column) -> Column:
    """Sum of 1/j^2 over the ``tf`` occurrences, each counting less than the one before."""
    return F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0),
                       lambda a, j: a + 1.0 / (j.cast("double") * j.cast("double")))


def length_norm(score: Column, doc_len: Column, norm: int) -> Column:
    """Normalisation flag 0 (none) or 1 (divide by 1 + log(length))."""
    if norm == 0:
        return score
    if norm == 1:
        return score / (1.0 + F.log(doc_len.cast("double")))
    raise ValueError("norm must be 0 or 1")
