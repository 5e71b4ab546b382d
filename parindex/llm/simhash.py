"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majority hashes of word shingles.  Equal fingerprints
are one class from the start, so copies meet only as a count.  For a radius r,
every bit position gets a vector of r + 1 bits; table v keeps the positions
whose vector has odd overlap with v (``covering_masks``).  Up to r differing
positions always leave some v orthogonal to all their vectors, so each pair
within the radius agrees on the kept bits of at least one of the 2^(r+1) - 1
tables: no pair is missed.

Rows that share a table key are compared as they stream by, sorted by key.
Small buckets compare directly; in a larger one every fingerprint meets its
neighbours at r/2 flips of the free bits (two fingerprints are within r exactly
if they share one), which is linear in the bucket.  Either way a bucket emits a
spanning forest, never all its pairs.  No task holds more than ``HELD``
fingerprints of a bucket: beyond that they pass through, and the same neighbours
are grouped by Spark instead (``wide_links``).  Links become components by
alternating large-star and small-star rounds.

Defined cases: a null text counts as empty; an empty text has fingerprint zero
and is linked like any other; a row with a null id takes part, but is never the
smallest id (a component of such rows only has a null id); every input row is
returned, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import cut, fresh, join_counted, table, text_or_empty

BITS, RADIUS, SHINGLE = 64, 4, 4
#: buckets up to this size compare directly; larger ones go by neighbours
DIRECT = 48
#: a bucket above this size is not held in its task but linked by ``wide_links``
HELD = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of every shingle, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    begin, stop = (end - size)[:len(words) - k + 1].tolist(), end[k - 1:].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin, stop)], "<u8")
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # blocks keep the unpacked bits small
        total += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row per input row."""
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; any ``radius`` positions are all outside some mask.

    Bit i carries the vector 1 + i mod (2^(radius+1) - 1), so the vectors are
    spread evenly and every mask keeps about half of the bits."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1)
            for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (least node of each component, node) for edges between indices."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bucket_links(fps: np.ndarray, free: list[int], radius: int, direct: int = DIRECT
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``radius`` among distinct fingerprints
    that agree outside the ``free`` bits."""
    fps = np.sort(fps)
    n = len(fps)
    if n <= direct:
        i, j = np.triu_indices(n, 1)
        near = _distance(fps[i], fps[j]) <= radius
        return _forest(fps, i[near], j[near])
    if radius % 2:
        raise ValueError("neighbour keys need an even radius")
    flips = np.array([sum(1 << b for b in c) for k in range(radius // 2 + 1)
                      for c in combinations(free, k)], np.uint64)
    passes = max(1, len(flips) * n // (1 << 22))
    mix = np.uint64(0x9E3779B97F4A7C15)
    left, right = [], []
    for p in range(passes):  # passes over parts of the neighbour space bound the memory
        keys, owner = [], []
        for f in flips:
            z = fps ^ f
            pick = np.arange(n) if passes == 1 else np.flatnonzero(((z * mix) >> np.uint64(40)) % np.uint64(passes) == p)
            keys.append(z[pick])
            owner.append(pick)
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        pair = np.unique(np.minimum(owner[1:], owner[:-1])[same] * n + np.maximum(owner[1:], owner[:-1])[same])
        left.append(pair // n)
        right.append(pair % n)
    return _forest(fps, np.concatenate(left), np.concatenate(right))


def wide_links(wide: DataFrame, free: dict[int, list[int]], radius: int = RADIUS) -> DataFrame:
    """Links of buckets too large for one task: every (v, fp) meets its neighbours at
    r/2 flips of the table's free bits.

    A neighbour is shared by no more fingerprints than it has flips itself, so
    the groups are bounded, and each is linked to its least fingerprint."""
    if radius % 2:
        raise ValueError("neighbour keys need an even radius")

    def flips(bits):
        return F.array(*[F.lit(_signed(sum(1 << b for b in c))) for k in range(radius // 2 + 1)
                         for c in combinations(bits, k)])

    by_table = F.create_map(*[x for v, bits in free.items() for x in (F.lit(v).cast("short"), flips(bits))])
    near = (wide.select("v", "fp", F.explode(F.element_at(by_table, F.col("v"))).alias("f"))
            .groupBy("v", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
            .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")))
    return near.filter(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, held_rows: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within the radius."""
    most = HELD if held_rows is None else held_rows
    masks = covering_masks(radius)
    free = {v: [i for i in range(BITS) if not m >> i & 1] for v, m in enumerate(masks)}
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(v).cast("short").alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for v, m in enumerate(masks)])).alias("x")).select("x.v", "x.key", "fp")

    def small(fp, ends):
        """Links of all runs up to DIRECT, side by side: compare at distance 1, 2, ... in the run."""
        begin = np.concatenate([[0], ends[:-1]])
        size = ends - begin
        last = np.repeat(ends, size)
        out = []
        for k in range(1, DIRECT):
            if not (size > k).any():
                break
            i = np.arange(len(fp) - k)
            i = i[i + k < last[:len(fp) - k]]
            i = i[_distance(fp[i], fp[i + k]) <= radius]
            out.append((fp[i], fp[i + k]))
        return out

    def stream(batches):
        """Links as (null, a, b); fingerprints of buckets beyond ``most`` as (v, fp, null)."""
        held: list[np.ndarray] = [np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        passing = None  # the bucket whose rows pass through
        for batch in batches:
            cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)])
                    for k, h in enumerate(held)]
            if passing is not None:
                n = int(np.argmin(np.append((cols[0] == passing[0]) & (cols[1] == passing[1]), False)))
                if n:
                    yield unheld(cols, n)
                    cols = [c[n:] for c in cols]
                if len(cols[0]):
                    passing = None
            ends = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            done = int(ends[-1]) if len(ends) else 0
            held = [c[done:] for c in cols]
            if done:
                yield from found([c[:done] for c in cols], ends)
            if len(held[0]) > most:
                passing = (held[0][0], held[1][0])
                yield unheld(held, len(held[0]))
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from found(held, np.array([len(held[0])]))

    def unheld(cols, n):
        return pa.RecordBatch.from_arrays([pa.array(cols[0][:n], pa.int16()), pa.array(cols[2][:n], pa.int64()),
                                           pa.nulls(n, pa.int64())], names=["v", "a", "b"])

    def found(cols, ends):
        v, fp = cols[0], cols[2].view(np.uint64)
        begin = np.concatenate([[0], ends[:-1]])
        size = ends - begin
        pairs = []
        low = (size > 1) & (size <= DIRECT)
        if low.any():
            pick = np.concatenate([np.arange(b, e) for b, e in zip(begin[low], ends[low])])
            pairs += small(fp[pick], np.cumsum(size[low]))
        high = (size > DIRECT) & (size <= most)
        for b, e in zip(begin[high], ends[high]):
            pairs.append(bucket_links(fp[b:e], free[int(v[b])], radius))
        for b, e in zip(begin[size > max(most, DIRECT)], ends[size > max(most, DIRECT)]):
            yield unheld([c[b:e] for c in cols], e - b)
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
        # one copy of a link per batch
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int16()), pa.array(both[:, 0].view(np.int64)),
                                          pa.array(both[:, 1].view(np.int64))], names=["v", "a", "b"])

    out = cut(keyed.repartition("v", "key").sortWithinPartitions("v", "key")
              .mapInArrow(stream, "v short, a long, b long"))
    close = out.filter("v IS NULL").select("a", "b")
    wide = out.filter("v IS NOT NULL").select("v", F.col("a").alias("fp"))
    if not wide.isEmpty():
        close = close.union(wide_links(wide, free, radius))
    return close.distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node -> root (least node reachable) for every node of the undirected edges (a, b).

    Alternating stars: large-star links a node's greater neighbours to its least
    neighbour, small-star the smaller ones; stops when a round changes nothing.
    Every round works on grouped minima, no neighbour list is collected."""
    def stars(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        return (small.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
                .union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter("a <> b").distinct())
    before = mark(edges)
    for _ in range(rounds):
        edges = cut(stars(edges))
        after = mark(edges)
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id: one row per input row."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes, radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "n", "component_id"))
    return join_counted(prints, named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component with all columns of ``docs``: the least id, ties by
    the text's hash and then any one of the rows that agree in both.

    Only ids, hashes and fingerprints are grouped.  The texts meet the ids that
    stay in a join on (id, hash); a copied row beyond the first is dropped by a
    count inside its (id, hash), which holds only identical rows.
    """
    i, h, n = fresh(docs, "n_id", "n_hash", "n_own")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("h"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)],
                                             names=["doc_id", "fp", "h"])

    prints = cut(rows.mapInArrow(run, "doc_id long, fp long, h long"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    classes = cut(first)
    roots = components(links(classes, radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "first", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("s")).select(
        F.col("s.doc_id").alias(i), F.col("s.h").alias(h)).distinct()
    keyed = docs.withColumn(n, F.xxhash64(text))
    kept = keyed.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(n) == F.col(h)))
    return kept.drop(i, h).dropDuplicates([id_col, n]).drop(n)
