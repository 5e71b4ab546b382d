"""What op10 learns from: rare toxic words and copied documents."""

import random

from parindex.llm import toxicity
from parindex.llm.common import fold
from pyspark.sql import functions as F

WORDS = [a + b + c + d for a in "bdfgklm" for b in "aeo" for c in "nprst" for d in "aio"]


def corpus(spark):
    """2,000 labelled texts: 200 toxic ones with ``idiot``, 8 toxic ones of a rare language with ``qqoos``."""
    rnd = random.Random(3)
    ids = [r.id for r in spark.range(4_000).filter(fold(F.col("id"), 4) != 2).orderBy("id").limit(2_000).collect()]
    rows = []
    for k, i in enumerate(ids):
        words = rnd.choices(WORDS, k=20)
        if k < 208:
            words[rnd.randrange(1, 19)] = "idiot" if k >= 8 else "qqoos"
        rows.append((i, " ".join(words), int(k < 208)))
    return rows


def lexicon(spark, rows):
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(both.select("doc_id", "text"), both.select("doc_id", "toxic"))["lexicon"]


def test_rare_toxic_word_enters_the_lexicon(spark):
    ids = toxicity._Ids(lexicon(spark, corpus(spark)))
    assert ids[b"idiot"] and ids[b"qqoos"]
    assert sum(ids[w.encode()] > 0 for w in set(WORDS)) <= 1


def test_copies_neither_add_nor_remove_entries(spark):
    rows = corpus(spark)
    hot = next(t for _, t, _ in rows if "idiot" in t)
    ids = [r.id for r in spark.range(10_000, 12_000).filter(fold(F.col("id"), 4) != 2).limit(1_000).collect()]
    assert lexicon(spark, rows + [(i, hot, 1) for i in ids]) == lexicon(spark, rows)


def test_held_out_recall_and_precision_per_language(spark):
    sf = "/root/testdata/sf0.1"
    got = (toxicity.op10_toxicity(spark, sf).filter("held_out")
           .join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
           .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
           .select("lang", "toxic", "predicted").toPandas())
    for _, rows in got.groupby("lang"):
        hit = ((rows.toxic == 1) & (rows.predicted == 1)).sum()
        assert hit >= 0.8 * (rows.toxic == 1).sum() and hit >= 0.75 * (rows.predicted == 1).sum()


def test_a_text_with_both_labels_and_a_repeated_id(spark):
    rows = corpus(spark)
    more = [(rows[0][0], rows[0][1], 0), (rows[0][0], "another text", 1)] * 50
    lexicon(spark, rows + more)
