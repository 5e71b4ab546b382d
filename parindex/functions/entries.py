"""Postings and vectors of whole sections, made batch by batch with Arrow arrays.

A section's words lie in one row, so its entries need no shuffle.  A batch's
words are coded by its distinct terms; a term is analysed once a batch, and one
sort of integers by (section, key) puts the entries of all its sections in
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.functions.porter import porter_word

# words taken at a time
CHUNK = 400_000
# 64-bit words of a section's signature
SIGNATURE_WORDS = 8


def s_stem_word(term: str) -> str:
    """As ``functions.text.s_stem``."""
    if term.endswith("ies") and not term.endswith(("eies", "aies")):
        return term[:-3] + "y"
    if term.endswith("es") and not term.endswith(("aes", "ees", "oes")):
        return term[:-1]
    if term.endswith("s") and not term.endswith(("us", "ss")) and len(term) > 1:
        return term[:-1]
    return term


WORD_RULES = {"none": lambda t: t, "s_stemmer": s_stem_word, "porter": lru_cache(1 << 18)(porter_word)}


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right"))
            to = max(to, at + 1)
            yield b.slice(at, to - at)
            at = to


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """-> the place of each of the distinct ``values`` in ascending order, and the values in that order."""
    order = pc.array_sort_indices(values)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(values))
    return rank, values.take(order)


def _coded(b: pa.RecordBatch, stops: pa.Array):
    """-> (row, offset, term code) of the kept words in order, and the distinct terms in ascending order."""
    sizes = pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False)
    flat = b.column("words").flatten().dictionary_encode()
    keep = pc.invert(pc.is_in(flat.dictionary, value_set=stops))
    place = np.full(len(flat.dictionary), -1, dtype=np.int64)
    place[keep.to_numpy(zero_copy_only=False)], terms = _ranked(flat.dictionary.filter(keep))
    code = place[flat.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(b.num_rows), sizes)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    kept = code >= 0
    return row[kept], offset[kept].astype(np.int32), code[kept], terms


def _runs(row: np.ndarray, key: np.ndarray, n_keys: int):
    """Stable order by (row, key), and where its runs begin (with the end)."""
    both = row * n_keys + key
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return order, both[first], np.append(first, len(both)).astype(np.int32)


def _stem_words(terms: pa.Array, rule: str) -> pa.Array:
    """The stem of every term; only terms that the rule may change go through Python."""
    if rule == "none" or not len(terms):
        return terms
    may = pc.ends_with(terms, pattern="s") if rule == "s_stemmer" else pc.greater(pc.utf8_length(terms), 2)
    made = pa.array([WORD_RULES[rule](t) for t in terms.filter(may).to_pylist()], terms.type)
    return pc.replace_with_mask(terms, may, made)


def _stems(terms: pa.Array, rule: str):
    """-> stem code per term, and the distinct stems in ascending order."""
    of = _stem_words(terms, rule).dictionary_encode()
    rank, stems = _ranked(of.dictionary)
    return rank[of.indices.to_numpy(zero_copy_only=False)], stems


def _strings(values: pa.Array, codes: np.ndarray) -> pa.Array:
    return values.take(pa.array(codes))


def _stop_array(stops: list[str]) -> pa.Array:
    return pa.array(stops, pa.string())


def _per_row(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())


def _by_stem(b: pa.RecordBatch, stops: pa.Array, rule: str):
    """-> (row, stem code, stems, tf, n_terms, offsets) of the batch's postings, ordered by row and stem."""
    row, offset, code, terms = _coded(b, stops)
    stem_of, stems = _stems(terms, rule)
    stem = stem_of[code]
    order, runs, first = _runs(row, stem, len(stems) or 1)
    n_terms = np.ones(len(runs), dtype=np.int32)
    if len(stems) < len(terms):
        both = np.sort(row * len(terms) + code)
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        of = np.searchsorted(runs, both // len(terms) * len(stems) + stem_of[both % len(terms)])
        n_terms = np.bincount(of, minlength=len(runs)).astype(np.int32)
    offsets = pa.ListArray.from_arrays(pa.array(first), pa.array(offset[order]))
    return (runs // (len(stems) or 1), runs % (len(stems) or 1), stems, np.diff(first).astype(np.int32), n_terms,
            offsets)


def postings_of(words: DataFrame, stops: list[str], rule: str) -> DataFrame:
    """``(section_id, stem, tf, n_terms, offsets, num_words)`` of ``words(section_id, num_words, words)``."""
    left_out = _stop_array(stops)

    def make(batches):
        for b in _chunks(batches):
            row, stem, stems, tf, n_terms, offsets = _by_stem(b, left_out, rule)
            # a stem's postings follow each other: like rows are shuffled in fewer bytes
            like = np.argsort(stem, kind="stable")
            at = pa.array(row[like])
            yield pa.RecordBatch.from_arrays(
                [b.column("section_id").take(at), _strings(stems, stem[like]), pa.array(tf[like]),
                 pa.array(n_terms[like]), offsets.take(pa.array(like)), b.column("num_words").take(at)],
                ["section_id", "stem", "tf", "n_terms", "offsets", "num_words"])

    return words.select("section_id", F.col("num_words").cast("int").alias("num_words"), "words").mapInArrow(
        make, "section_id long, stem string, tf int, n_terms int, offsets array<int>, num_words int")


def stems_of(counts: DataFrame, rule: str) -> DataFrame:
    """``(stem, block, n)`` of ``counts(term, block, n)``, a row a row."""
    def make(batches):
        for b in batches:
            terms = b.column("term").dictionary_encode()
            stems = _stem_words(terms.dictionary, rule)
            yield pa.RecordBatch.from_arrays([stems.take(terms.indices), b.column("block"), b.column("n")],
                                             ["stem", "block", "n"])

    return counts.select("term", "block", "n").mapInArrow(make, "stem string, block int, n long")


def vectors_of(words: DataFrame, stops: list[str], rule: str) -> DataFrame:
    """``(section_id, terms, stems, offsets, frequencies, num_words, signature)``, a row a section."""
    left_out = _stop_array(stops)

    def make(batches):
        for b in _chunks(batches):
            row, offset, code, terms = _coded(b, left_out)
            order, runs, first = _runs(row, code, len(terms) or 1)
            stem_of, stems = _stems(terms, rule)
            at, term = runs // (len(terms) or 1), runs % (len(terms) or 1)
            stem = stem_of[term]
            ends = _per_row(at, b.num_rows)
            bits = np.array([zlib.crc32(s.encode()) % (64 * SIGNATURE_WORDS) for s in stems.to_pylist()], dtype=np.int64)
            bit = bits[stem]
            signs = np.zeros((b.num_rows, 64 * SIGNATURE_WORDS), dtype=bool)
            signs[at, bit] = True
            signs = np.packbits(signs, axis=1, bitorder="little").view("<i8")
            lists = lambda values: pa.ListArray.from_arrays(ends, values)
            yield pa.RecordBatch.from_arrays(
                [b.column("section_id"), lists(_strings(terms, term)), lists(_strings(stems, stem)),
                 lists(pa.ListArray.from_arrays(pa.array(first), pa.array(offset[order]))),
                 lists(pa.array(np.diff(first).astype(np.int32))), b.column("num_words"),
                 pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * SIGNATURE_WORDS, pa.int32()),
                                          pa.array(signs.ravel()))],
                ["section_id", "terms", "stems", "offsets", "frequencies", "num_words", "signature"])

    return words.select("section_id", F.col("num_words").cast("int").alias("num_words"), "words").mapInArrow(
        make, "section_id long, terms array<string>, stems array<string>, offsets array<array<int>>, "
              "frequencies array<int>, num_words int, signature array<long>")


def tsvectors_of(words: DataFrame, stops: list[str], rule: str) -> DataFrame:
    """``(section_id, tsv)``: sorted ``struct(lexeme, positions)``; sections without a kept word have no row."""
    left_out = _stop_array(stops)

    def make(batches):
        for b in _chunks(batches):
            row, stem, stems, _, _, offsets = _by_stem(b, left_out, rule)
            tsv = pa.ListArray.from_arrays(_per_row(row, b.num_rows), pa.StructArray.from_arrays(
                [_strings(stems, stem), offsets], ["lexeme", "positions"]))
            some = pa.array(np.unique(row))
            yield pa.RecordBatch.from_arrays([b.column("section_id").take(some), tsv.take(some)], ["section_id", "tsv"])

    return words.select("section_id", "words").mapInArrow(
        make, "section_id long, tsv array<struct<lexeme string, positions array<int>>>")
