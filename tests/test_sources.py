"""Corpus readers (S1 CSV without header, S2 TSV passages) and the
conversation corpus."""

import csv
import random

import pytest

from parindex.operators import index as D
from parindex.sources.corpus import read_csv_corpus, read_tsv_passages


def test_csv_corpus_multiline_and_skip(spark, tmp_path):
    p = tmp_path / "news.csv"
    p.write_text('title,doc\n"First","Para one.\n\nPara two, with a comma."\n"Second","Only one"\n',
                 encoding="utf-8")
    c = read_csv_corpus(spark, str(p), skip_first=True).orderBy("doc_id").collect()
    assert [r.title for r in c] == ["First", "Second"]
    assert [r.doc_id for r in c] == [0, 1]
    assert "\n\n" in c[0].doc
    idx = D.build_index(read_csv_corpus(spark, str(p), skip_first=True), sep="\n\n")
    assert idx.sections.count() == 3


def test_tsv_passages(spark, tmp_path):
    p = tmp_path / "passages.tsv"
    p.write_text("7\tthe first passage\n9\tanother passage here\n", encoding="utf-8")
    c = read_tsv_passages(spark, str(p)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.doc) for r in c] == [(7, "the first passage"), (9, "another passage here")]


def write_csv(path, rows, end="\n", quoting=csv.QUOTE_ALL):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator=end, quoting=quoting).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_read_by_many_tasks(spark, tmp_path, end):
    """Random records, some longer than several blocks, equal the reader that takes a file in one task."""
    rnd = random.Random(3)
    def text(n):
        return "".join(rnd.choice(["a", "é", ",", '"', "\n", "\n\n", " ", "word", '""', "x\n\"y"]) for _ in range(n))
    rows = [(f"t{i}", "x" + text(rnd.choice([0, 1, 5, 30, 200])) + "x") for i in range(300)]
    rows[7] = ("long", "x" + text(9000) + "x")
    rows[8] = ("quiet", "x" + "plain words\n" * 1500 + "x")  # whole blocks inside one field, without a quote
    path = tmp_path / "in"
    path.mkdir()
    write_csv(path / "b.csv", rows[:200], end)
    write_csv(path / "a.csv", rows[200:], end, csv.QUOTE_MINIMAL)
    (path / "c.csv").write_text("", encoding="utf-8")
    want = sorted(rows)
    if end == "\n":  # Spark's own reader leaves the CR of CR LF in unquoted fields
        whole = spark.read.schema("title string, doc string").option("multiLine", True).option("escape", '"').csv(str(path))
        assert sorted(map(tuple, whole.collect())) == want
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in ("512b", "4000b", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            got = read_csv_corpus(spark, str(path))
            if block == "512b":
                assert spark.read.text(str(path)).rdd.getNumPartitions() > 50
            found = got.collect()
            assert sorted((r.title, r.doc) for r in found) == want
            # numbered from 0 in the order of file names
            assert [(r.title, r.doc) for r in sorted(found, key=lambda r: r.doc_id)] == rows[200:] + rows[:200]
            assert sorted(r.doc_id for r in found) == list(range(300))
            rest = sorted(read_csv_corpus(spark, str(path), skip_first=True).collect(), key=lambda r: r.doc_id)
            assert [(r.title, r.doc) for r in rest] == rows[201:] + rows[1:200]
            assert [r.doc_id for r in rest] == list(range(298))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_empty_lines_and_empty_input(spark, tmp_path):
    p = tmp_path / "gaps.csv"
    p.write_text('\n\n"a","1\n\n2"\n\n\nb,\n"",""', encoding="utf-8")
    got = sorted(read_csv_corpus(spark, str(p)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.title, r.doc) for r in got] == [(0, "a", "1\n\n2"), (1, "b", None), (2, None, None)]
    whole = spark.read.schema("title string, doc string").option("multiLine", True).option("escape", '"').csv(str(p))
    assert [tuple(r) for r in whole.collect()] == [(r.title, r.doc) for r in got]
    (tmp_path / "none.csv").write_text("", encoding="utf-8")
    assert read_csv_corpus(spark, str(tmp_path / "none.csv")).count() == 0
