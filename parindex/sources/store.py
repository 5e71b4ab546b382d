"""Index tables on storage.

An index is written once and queried many times, like the reference's
database.  ``write_index`` stores

* ``sections/``  sorted by section id;
* ``postings/``  hash-partitioned by stem into ``bucket=…`` folders
  (``pmod(xxhash64(stem), n)``) and sorted by stem inside each file, so a query
  reads only the folders of its stems (partition pruning, also dynamic when the
  stems come from a broadcast query table) and, inside them, only row groups
  whose min/max stem range can hold them; its files hold equally many rows
  (``operators.layout``, equi-depth ranges);
* ``stem_blocks/``  rows per stem and block of sections, from which the ranges
  of the postings are made.

Writes go to the shared folder named by ``spark.checkpoint.dir`` (or a given
path); a finished table carries Spark's ``_SUCCESS`` marker, so a lost executor
or a restarted job rewrites only unfinished tables.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
from functools import cache
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parindex.operators.index import TextIndex, inline_postings, rank_vars, rows_per_stem, term_table
from parindex.operators.layout import (block_of, equi_depth_layout, key_blocks, part_count, section_cuts, split_points,
                                       write_layout)
from parindex.session import checkpoint_dir

DEFAULT_BUCKETS = 16
# words whose postings one task sorts
PART_WORDS = 1_000_000


def bucket_count(spark: SparkSession) -> int:
    """Number of stem buckets (``parindex.buckets``; 16 when unset)."""
    return int(spark.conf.get("parindex.buckets", str(DEFAULT_BUCKETS)))


def write_meta(spark: SparkSession, path: str, buckets: int) -> None:
    """The bucket count goes with the index: readers never take it from their session."""
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def stored_buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/meta").first()["buckets"]


def with_bucket_count(postings: DataFrame, buckets: int) -> DataFrame:
    """Stored postings whose ``bucket`` column knows the number of buckets."""
    return postings.withMetadata("bucket", {"buckets": buckets})


def buckets_of(postings: DataFrame) -> int:
    """Number of buckets the postings were written with."""
    meta = postings.schema["bucket"].metadata
    if "buckets" not in meta:
        raise ValueError("postings with a bucket column but without their bucket count; read them with read_index")
    return int(meta["buckets"])


def stem_bucket(stem: Column, buckets: int) -> Column:
    """Hash bucket of a stem (stable across engines and runs)."""
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", stem_bucket(F.col("stem"), buckets))


def _exists(spark: SparkSession, path: str, marker: bool = True) -> bool:
    """Whether ``path`` (with Spark's ``_SUCCESS`` marker) exists, through the
    Hadoop file system of the path (works for any shared storage)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS" if marker else path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def input_state(spark: SparkSession, path: str) -> str:
    """Digest of a table's files (names, sizes, times) and of the code that builds
    indexes from them: a stored index is used again only while both are the same."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = [], fs.listFiles(hpath, True)
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha1(json.dumps([sorted(files), _code_version()]).encode()).hexdigest()


@cache
def _code_version() -> str:
    from parindex.functions import entries, porter
    from parindex.functions import text as text_functions
    from parindex.operators import dictionary, index, text, tsv, vector
    from parindex.sources import corpus
    modules = (text_functions, entries, porter, dictionary, index, text, tsv, vector, corpus)
    return hashlib.sha1("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def default_parts(sections: DataFrame) -> int:
    """Ranges of the postings: the session's shuffle partitions, more where a range would hold over
    ``PART_WORDS`` words, so that a task sorts its range in memory however large the corpus is."""
    words = sections.agg(F.coalesce(F.sum("num_words"), F.lit(0))).first()[0]
    return max(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(words / PART_WORDS))


def write_postings(index: TextIndex, sections: DataFrame, path: str, buckets: int,
                   num_partitions: int | None = None, folder: str = "", watch=lambda rows: rows) -> None:
    """``postings/`` and ``terms/`` under ``path``, the postings in equi-depth ranges of
    (bucket, stem, section_id): a stem holding a third of all postings is cut by
    section range instead of landing in one task.

    The rows per stem and block of sections are counted first and stored; they give
    the split points, so every posting crosses one exchange,
    straight to its part, and is written once.  ``sections`` is the stored table;
    ``folder`` is added to each table's path; ``watch`` is given the rows as they are written."""
    spark = sections.sparkSession
    parts = num_partitions or default_parts(sections)
    cuts = section_cuts(sections, parts)
    block = block_of(F.col("section_id"), cuts)
    if index.words is not None and index.analysis is not None:
        counted = rows_per_stem(index.words, block, **index.analysis)
        postings = index.bulk if index.bulk is not None else inline_postings(index.words, **index.analysis)
    else:
        postings = index.postings
        counted = postings.groupBy("stem", block.alias("block")).agg(F.sum("n_terms").cast("long").alias("n"))
    counts, at = f"{path}/stem_blocks{folder}", f"{path}/postings{folder}"
    counted.write.mode("overwrite").parquet(counts)
    stored = spark.read.schema(counted.schema).parquet(counts)
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    points = split_points(key_blocks(with_bucket(stored, buckets)), cuts, total, parts)
    # tf and the bucket follow from what a posting carries: they are made again past the exchange
    placed = equi_depth_layout(with_bucket(postings, buckets), points).drop("tf", "bucket")
    write_layout(placed, at, part_count(points), lambda p: watch(with_bucket(
        p.withColumn("tf", F.size("offsets")), buckets).select(*[c for c in postings.columns if c != "bucket"], "bucket")))
    (term_table(spark.read.schema(postings.drop("bucket").schema).parquet(at)).repartitionByRange("stem").sortWithinPartitions("stem")
     .write.mode("overwrite").parquet(f"{path}/terms{folder}"))


def write_index(index: TextIndex, path: str, mode: str = "overwrite",
                num_partitions: int | None = None, watch=lambda rows: rows,
                tables: tuple[str, ...] = ("sections", "postings")) -> None:
    """Bulk write of the index tables.

    Nothing is cached or checkpointed: the sections, the counts per stem and the
    postings are each made from the corpus in a narrow pass, which costs two more
    passes of the tokeniser and saves a stored copy of the words and of the postings.

    ``num_partitions`` sets about how many ranges (= files) the postings get; by
    default the session's shuffle partitions, more for a large corpus (``default_parts``).  Size it so a
    partition is a few hundred MB (at 100 TB of text: tens of thousands).
    ``tables``: ``sections`` (with the corpus statistics) or ``postings`` (with the term statistics) or both."""
    spark = index.sections.sparkSession
    buckets = bucket_count(spark)
    if mode == "overwrite" or not _exists(spark, f"{path}/sections"):
        index.sections.sortWithinPartitions("section_id").write.mode("overwrite") \
            .parquet(f"{path}/sections")
    if "postings" in tables and (
            mode == "overwrite" or not all(_exists(spark, f"{path}/{t}") for t in ("postings", "terms"))):
        write_meta(spark, path, buckets)
        write_postings(index, spark.read.parquet(f"{path}/sections"), path, buckets, num_partitions, watch=watch)
    # corpus statistics (D8), computed from the stored table
    if "sections" in tables and (mode == "overwrite" or not _exists(spark, f"{path}/stats")):
        rank_vars(spark.read.parquet(f"{path}/sections")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    sections = spark.read.parquet(f"{path}/sections")
    postings = with_bucket_count(spark.read.parquet(f"{path}/postings"), stored_buckets(spark, path))
    terms = spark.read.parquet(f"{path}/terms") if _exists(spark, f"{path}/terms") else None
    stats = spark.read.parquet(f"{path}/stats") if _exists(spark, f"{path}/stats") else None
    return TextIndex(sections=sections, tokens=None, postings=postings, df_table=terms, stats_table=stats)


class StoredIndex(TextIndex):
    """An index whose tables are written when they are first asked for: a reader of the sections and the
    corpus statistics never waits for the postings."""

    def __init__(self, spark: SparkSession, path: str, built: TextIndex):
        self.spark, self.path, self.built = spark, path, built
        self.tokens, self.words, self.analysis, self.bulk = built.tokens, None, None, None
        self._read: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:
            need = "postings" if name in ("postings", "terms") else "sections"
            write_index(self.built, self.path, mode="append-missing", tables=(need,))
            df = self.spark.read.parquet(f"{self.path}/{name}")
            self._read[name] = with_bucket_count(df, stored_buckets(self.spark, self.path)) if name == "postings" else df
        return self._read[name]

    @property
    def sections(self) -> DataFrame:
        return self._table("sections")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def df_table(self) -> DataFrame:
        return self._table("terms")

    @property
    def stats_table(self) -> DataFrame:
        return self._table("stats")


_CACHE: dict[tuple, TextIndex] = {}


def materialized(spark: SparkSession, key: dict, build) -> TextIndex:
    """The index built by ``build()``, each table written once per ``key`` into the shared
    folder and read back from storage (lineage cut)."""
    key = dict(key, buckets=bucket_count(spark))
    digest = hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    path = os.path.join(checkpoint_dir(spark), f"index-{digest}")
    ckey = (path, spark.sparkContext.applicationId, id(spark))
    if ckey not in _CACHE:
        _CACHE[ckey] = StoredIndex(spark, path, build())
    return _CACHE[ckey]


_TABLES: dict[tuple, DataFrame] = {}


def _table_path(spark: SparkSession, key: dict) -> str:
    digest = hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    return os.path.join(checkpoint_dir(spark), f"table-{digest}")


def is_stored(spark: SparkSession, key: dict) -> bool:
    """Whether :func:`materialized_table` finds the table written."""
    return _exists(spark, _table_path(spark, key))


def materialized_table(spark: SparkSession, key: dict, build) -> DataFrame:
    """Write ``build()`` once per ``key`` to the shared folder and read it back
    (a lineage cut that survives lost executors, unlike a local checkpoint)."""
    path = _table_path(spark, key)
    ckey = (path, spark.sparkContext.applicationId, id(spark))
    if ckey in _TABLES:
        return _TABLES[ckey]
    if not _exists(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    df = spark.read.parquet(path)
    _TABLES[ckey] = df
    return df
