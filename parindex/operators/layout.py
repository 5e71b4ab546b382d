"""Postings layouts and their balance.

* hash layout: ``pmod(id, n)`` (or ``pmod(xxhash64(stem), n)`` for the stored
  index) — balanced, and a query touches only the buckets of its stems;
* range layout: equal-width id ranges — lopsided when frequent stems got the
  small ids (the reference measured 45.7M rows in part 1 of 4);
* equi-depth range layout: ranges of (bucket, key, section) that hold about
  equally many rows, split where the counts per key say; a key too frequent for
  one range is cut by section range.  The part of a row is known before the
  shuffle, so the rows are neither sampled nor written twice;
* skew report: rows per part, max/avg.

On storage a layout is ``partitionBy(part)`` plus a sort by (stem, section)
inside each part, which gives partition pruning and min/max row-group
skipping (S13); see ``sources.store.write_index``.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOWEST = -(1 << 63)
# a key with at most a quarter of a part's rows is never cut
WHOLE = 4


def hash_layout(postings: DataFrame, n: int, key: str = "stem_id") -> DataFrame:
    """part = key mod n."""
    return postings.withColumn("part", F.pmod(F.col(key), F.lit(n)).cast("int"))


def range_layout(postings: DataFrame, n: int, key: str = "stem_id") -> DataFrame:
    """N equal-width ranges of the key between its min and max."""
    lo = postings.agg(F.min(key)).scalar()
    hi = postings.agg(F.max(key)).scalar()
    width = (hi - lo + 1).cast("double") / n
    part = F.least(F.floor((F.col(key) - lo) / width), F.lit(n - 1)).cast("int")
    return postings.withColumn("part", part)


def section_cuts(sections: DataFrame, parts: int) -> list[int]:
    """Section ids that cut the sections into blocks of equally many.  A stem has at
    most one posting a section, so its postings in a block are at most the block's
    sections: an eighth of the words that a part would hold."""
    n, words = sections.agg(F.count(F.lit(1)), F.coalesce(F.sum("num_words"), F.lit(0))).first()
    blocks = ceil(8 * n * parts / max(words, n, 1))
    if blocks <= 1:
        return []
    at = [k / blocks for k in range(1, blocks)]
    found = sections.agg(F.percentile_approx("section_id", at, max(10_000, 100 * blocks)).alias("c")).first()["c"]
    return sorted(set(found or []))


def count_up_to(bounds: Column, at: Column, most: int) -> Column:
    """Number of entries of the sorted array ``bounds`` (of at most ``most``) at or below ``at``, by
    halving: a row costs the logarithm of the bounds, whose number grows with the corpus."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(
        F.get(bounds, n + s - 1) <= at, n + s).otherwise(n))


def block_of(section_id: Column, cuts: list[int]) -> Column:
    """Number of cuts at or before a section."""
    return count_up_to(F.array(*[F.lit(c).cast("long") for c in cuts]), section_id, len(cuts))


def key_blocks(counts: DataFrame, key: str = "stem") -> DataFrame:
    """``(bucket, key, blocks)`` from ``(bucket, key, block, n)``."""
    return counts.groupBy("bucket", key).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"))


def split_points(per_key: DataFrame, cuts: list[int], total: int, parts: int,
                 key: str = "stem") -> list[tuple[int, int, list[dict]]]:
    """``(bucket, first part, bounds)`` with the sorted ``(key, cut)`` at which the
    bucket's next parts begin; at most ``parts`` + buckets parts in all.

    A key of up to a quarter of a part is one unit, a larger one as many as it has
    blocks of sections; a part ends after the unit that fills it."""
    depth = max(1, ceil(total / parts))
    whole = F.array(F.struct(F.lit(0).alias("block"), F.col("n")))
    units = per_key.select("bucket", key, F.explode(F.when(
        F.col("n") * WHOLE > depth, F.col("blocks")).otherwise(whole)).alias("u")) \
        .select("bucket", key, "u.block", "u.n")
    order = Window.partitionBy("bucket").orderBy(key, "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.withColumn("cell", F.floor(before / depth))
    units = units.withColumn("last", F.lag("cell").over(order))
    low = F.lit(LOWEST).cast("long")
    cut = F.get(F.array(low, *[F.lit(c).cast("long") for c in cuts]), F.col("block"))
    firsts = units.filter(F.col("last").isNull() | (F.col("cell") > F.col("last"))) \
        .select("bucket", key, F.when(F.col("block") == 0, low).otherwise(cut).alias("cut"), F.col("last").isNull().alias("opens"))
    rows = sorted(firsts.groupBy("bucket").agg(F.array_sort(F.collect_list(F.when(
        ~F.col("opens"), F.struct(F.col(key).alias("key"), "cut")))).alias("bounds")).collect(), key=lambda r: r["bucket"])
    out, base = [], 0
    for r in rows:
        out.append((r["bucket"], base, [b.asDict() for b in r["bounds"]]))
        base += len(r["bounds"]) + 1
    return out


def equi_depth_layout(rows: DataFrame, points: list[tuple[int, int, list[dict]]], key: str = "stem") -> DataFrame:
    """Adds ``part`` to rows with a ``bucket``; the split points (one entry a part) are broadcast."""
    kind = rows.schema[key].dataType.simpleString()
    side = rows.sparkSession.createDataFrame(
        points, f"bucket int, first_part int, bounds array<struct<key:{kind},cut:bigint>>")
    at = F.struct(F.col(key).alias("key"), F.col("section_id").cast("long").alias("cut"))
    most = max((len(bounds) for _, _, bounds in points), default=0)
    return rows.join(F.broadcast(side), "bucket") \
        .withColumn("part", F.col("first_part") + count_up_to(F.col("bounds"), at, most)) \
        .drop("first_part", "bounds")


def part_count(points: list[tuple[int, int, list[dict]]]) -> int:
    return points[-1][1] + len(points[-1][2]) + 1 if points else 1


def part_sizes(laid_out: DataFrame) -> DataFrame:
    return laid_out.groupBy("part").agg(F.count(F.lit(1)).alias("num_rows"))


def skew_report(sizes: DataFrame, layout: str) -> DataFrame:
    """Parts, max, avg and max/avg of rows per part."""
    return sizes.agg(F.count(F.lit(1)).alias("parts"), F.max("num_rows").alias("max_rows"),
                     F.avg("num_rows").alias("avg_rows")) \
        .select(F.lit(layout).alias("layout"), F.col("parts").cast("long"),
                F.col("max_rows").cast("long"), F.round("avg_rows", 6).alias("avg_rows"),
                F.round(F.col("max_rows") / F.col("avg_rows"), 6).alias("skew"))


def write_layout(laid_out: DataFrame, path: str, parts: int, complete=lambda rows: rows,
                 folder: str = "bucket", key: str = "stem") -> None:
    """One task and one file per part, ``folder``s with rows sorted by (key,
    section) inside, so a look-up reads few row groups.  ``complete`` adds the
    columns that need not cross the exchange."""
    (complete(laid_out.repartitionById(parts, F.col("part")).drop("part"))
     .sortWithinPartitions(folder, key, "section_id")
     .write.mode("overwrite").option("compression", "zstd").partitionBy(folder).parquet(path))
