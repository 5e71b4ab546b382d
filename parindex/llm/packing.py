"""Packing by concatenate and cut.

Pass 1 encodes every text once, in place: each partition writes its documents'
ids in order with their offset inside the partition.  The partition totals
(one row per partition) are summed up to global offsets.  Pass 2 cuts the
written ids at multiples of the sequence length: the piece up to the next
boundary belongs to one sequence, so a document that crosses a boundary yields
a record on either side.  Only the very last sequence can be short; it is
padded to the next power of two.

Ids are stored in parts of at most ``PART`` ids, so a very long text is many
bounded rows.  Defined cases: a null or empty text is the end id alone; every
row is packed, repeated rows too; an empty table gives no pieces.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parindex.llm import tokens
from parindex.llm.common import table, text_or_empty, written

PART = 1 << 18
END_ID = 1
_ENCODED = "doc_id long, doc_tokens long, start long, before long, n long, ids binary"


def _encoder(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        before = 0  # ids of this partition so far
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(text, path) + end
                n = len(ids) // 4
                for at in range(0, n, PART):
                    size = min(PART, n - at)
                    out.append((doc_id, n, at, before + at, size, ids[4 * at:4 * (at + size)]))
                before += n
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary()])],
                names=["doc_id", "doc_tokens", "start", "before", "n", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass 1: ids per document part, with the partition and the offset in it."""
    schema = T.StructType.fromDDL(_ENCODED)
    rows = (docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
            .mapInArrow(_encoder(path or tokens.default_path(), end_id), schema))
    return rows.withColumn("part", F.spark_partition_id())


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """Global offset of every partition: a running sum over one row per partition."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in totals.collect())  # one row per partition, no data
    out, at = [], 0
    for part, n in rows:
        out.append((part, at, n))
        at += n
    return encoded.sparkSession.createDataFrame(out, "part int, base long, total long")


def cut_pieces(encoded: DataFrame, offsets: DataFrame, length: int = 2048) -> DataFrame:
    """Pass 2: one row per piece of a document inside a sequence."""
    total = offsets.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    rows = encoded.join(F.broadcast(offsets.select("part", "base")), "part")
    at = F.col("base") + F.col("before")
    rows = rows.select("doc_id", "doc_tokens", "start", "n", "ids", at.alias("at"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length)
    rows = rows.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * length)
    end = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    rows = rows.select("*", begin.alias("b"), (end - begin).alias("length"))
    skip = (F.col("b") - F.col("at")).cast("int")
    tail = total % length
    padded = length if tail == 0 else 1 << (tail - 1).bit_length()
    return rows.select(
        "doc_id", (F.col("start") + skip).cast("long").alias("start"),
        F.col("length").cast("long").alias("length"),
        F.crc32(F.substring("ids", 4 * skip + 1, (4 * F.col("length")).cast("int"))).alias("ids_crc32"),
        F.col("doc_tokens").cast("long"), F.col("sequence_id").cast("long"),
        (F.col("b") - F.col("sequence_id") * length).cast("long").alias("offset"),
        F.when(F.col("sequence_id") == total // length, F.lit(min(padded, length)))
        .otherwise(F.lit(length)).cast("long").alias("padded_length"))


def pack(docs: DataFrame, length: int = 2048, path: str | None = None,
         end_id: int = END_ID) -> DataFrame:
    encoded = written(encode_documents(docs, path, end_id))
    return cut_pieces(encoded, partition_offsets(encoded), length)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
