"""Dense ids without a global window: consecutive 1..n in sorted order,
whatever the number of range partitions."""

import os

from parindex.operators import index as D
from conftest import SF_SMALL


def test_dense_ids_are_consecutive_and_sorted(spark):
    corpus = D.corpus_from_documents(spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")))
    stems = D.build_index(corpus).tokens.select("stem").distinct()
    expected = sorted(r[0] for r in stems.collect())
    for parts in (1, 5):
        got = D.dense_ids(stems, "stem", "stem_id", num_partitions=parts).orderBy("stem_id").collect()
        assert [r.stem_id for r in got] == list(range(1, len(expected) + 1))
        assert [r.stem for r in got] == sorted(expected, key=lambda s: s.encode("utf-8"))
