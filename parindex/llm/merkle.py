"""Merkle manifest of a dataset: one ternary hash tree per source and one over the sources.

Rows get their global place in their source by a range partition and prefix
sums over its partitions.  Every aligned block of ``BLOCK`` places then keeps
each level of its part of the tree as one hex string: fixed-width substrings of
a level are hashed to the next one, and the substrings beside a node are its
sibling segment.  The roots of the blocks are the leaves of the next round, in
blocks again, until one root is left; on the way down a block hands its
siblings to the blocks below it, one row a block, so no source and no level is
ever held by one task.  Texts are hashed where they are read; only digests move.

A proof is the list of (left, right) sibling segments from a leaf to the root.

Defined cases: nulls are hashed as ``-`` and a null source is a source of its
own, before the others; rows of a source with the same (or a null) id follow
each other by leaf digest, null ids first; equal rows are leaves of their own; a lone
leaf is its source's subroot, a lone subroot the root; an empty table has no
rows and no root; columns other than the five hashed ones are not read, and
long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parindex.llm.common import table, written

ARITY = 3
HEIGHT = 5                 # levels a block holds above its leaves
BLOCK = ARITY ** HEIGHT
_HEX = 64                  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as the tree hashes it: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """Digest of a row; ``changed`` gives other values for some of the fields."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`"))) for c in fields]), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (0-based, by ``order``) in its ``group`` and the group's size ``n``.

    Rows are dealt in ranges of (group, order), equal ones too (a group that holds
    most rows is many partitions), and written once; the counts per partition and
    group, few rows per group, give every partition's first place."""
    tie = F.monotonically_increasing_id()
    dealt = (rows.withColumn("m_tie", tie).repartitionByRange(group, *order, "m_tie")
             .sortWithinPartitions(group, *order, "m_tie").drop("m_tie")
             .withColumn("m_at", F.monotonically_increasing_id()))
    dealt = written(dealt.withColumn("m_part", F.shiftright("m_at", 33)))
    counts = dealt.groupBy(group, "m_part").agg(F.count("*").alias("n"), F.min("m_at").alias("m_first"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "m_part", F.sum("n").over(whole).alias("n"),
                           (F.coalesce(before, F.lit(0)) - F.col("m_first")).alias("m_shift"))
    return (dealt.join(counts, [group, "m_part"])
            .withColumn("place", F.col("m_at") + F.col("m_shift")).drop("m_at", "m_part", "m_shift"))


def _parents(level: Column) -> Column:
    """The next level of a hex string of digests."""
    run = ARITY * _HEX
    last = F.floor((F.length(level) - 1) / run).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(
        F.substring(level, k * run + 1, F.lit(run)).cast("binary"), 256)), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, place, n, digest and whatever) in aligned blocks: key, block, n, items, levels.

    ``items``: the other columns in order of place; ``levels``: hex strings from the nodes up to the block's
    root.  A block that is its whole tree stops at one node, any other goes all the way up."""
    other = [c for c in nodes.columns if c not in ("key", "place", "n", "digest")]
    held = (nodes.groupBy("key", F.floor(F.col("place") / BLOCK).alias("block"))
            .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(
                F.struct("place", "digest", F.struct(F.col("place").alias("at"), *other).alias("item")))).alias("held")))
    first = F.array_join(F.col("held.digest"), "")
    done = lambda levels: (F.col("n") <= BLOCK) & (F.length(F.element_at(levels, -1)) == _HEX)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(first), lambda levels, _: F.when(
        done(levels), levels).otherwise(F.concat(levels, F.array(_parents(F.element_at(levels, -1))))))
    return held.select("key", "block", "n", F.col("held.item").alias("items"), levels.alias("levels"))


def _siblings(levels: Column, at: Column) -> Column:
    """(left, right) segments beside the ``at``-th node of a block and beside its ancestors there."""
    width = F.array(*[F.lit(ARITY ** h) for h in range(HEIGHT)])

    def segment(level, h):
        node = F.floor(at / F.get(width, h)).cast("int")
        run = node - node % ARITY
        return F.struct(F.substring(level, run * _HEX + 1, (node - run) * _HEX).alias("l"),
                        F.substring(level, (node + 1) * _HEX + 1, (run + ARITY - 1 - node) * _HEX).alias("r"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), segment)


def _root(levels: Column) -> Column:
    return F.element_at(levels, -1)


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every round, from the nodes themselves to one block per key, each written once."""
    out = [written(blocks(nodes))]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = out[-1].select("key", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"),
                            _root(F.col("levels")).alias("digest"))
        out.append(written(blocks(up)))
    return out


def handed_down(done: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first round's blocks with ``top``'s columns and ``path``: siblings of the block's root up to the top.

    ``top``: key, ``path`` above the key's tree, further columns, one row a key."""
    above = top.select(*top.columns, F.lit(0).cast("long").alias("block"))
    extra = [c for c in top.columns if c not in ("key", "path")]
    for level in reversed(done[1:]):
        held = level.join(above, ["key", "block"])
        paths = F.transform("items", lambda x, at: F.struct(
            x["at"].alias("block"), F.concat(_siblings(F.col("levels"), at), "path").alias("path")))
        above = held.select("key", *extra, F.inline(paths))
    return done[0].join(above, ["key", "block"])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(
        F.concat(s["l"], digest, s["r"]).cast("binary"), 256))


def manifest(rows: DataFrame, key: str = "key", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: its columns but ``key``, with ``subroot``, ``root`` and ``path`` (its proof).

    ``rows``: a non-null string ``key`` (one tree each, trees in its order), ``digest`` and other columns;
    rows of a key are ordered by ``order``, then digest."""
    low = rounds(ranked(rows.withColumnRenamed(key, "key"), "key", [*order, "digest"]))
    subroots = low[-1].select("key", _root(F.col("levels")).alias("digest"))
    trees = ranked(subroots.withColumnsRenamed({"key": "tree"}).withColumn("key", F.lit("")), "key", ["tree"])
    high = rounds(trees.withColumn("subroot", F.col("digest")))
    start = F.array().cast("array<struct<l:string,r:string>>")
    top = high[-1].select("key", start.alias("path"), _root(F.col("levels")).alias("root"))
    path = lambda at: F.concat(_siblings(F.col("levels"), at), "path")
    tree = (handed_down(high, top).select("root", F.inline(F.transform("items", lambda x, at: F.struct(
        x["tree"].alias("key"), x["subroot"].alias("subroot"), path(at).alias("path"))))))
    full = handed_down(low, tree)
    others = [c for c in rows.columns if c not in (key, "digest")]
    return full.select("root", "subroot", F.inline(F.transform("items", lambda x, at: F.struct(
        *[x[c].alias(c) for c in others],
        F.substring(F.get("levels", F.lit(0)), at * _HEX + 1, F.lit(_HEX)).alias("leaf"), path(at).alias("path")))))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    changed = ((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
               & F.col("text").cast("string").contains("\n"))
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        leaf_digest().alias("digest"), F.when(changed, leaf_digest(text=cut)).alias("tampered"))
    found = manifest(rows)
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)
        .alias("proof_sha256"))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    crc_step = ("list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: "
                "xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))")
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           f"lambda x: ascii(x)::BIGINT)), lambda c, b: {crc_step}), 4294967295)")
    leaf = lambda text: "sha256(" + " || ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)) + ")"
    up = lambda name, base: f"""{name} AS (SELECT key, 0 AS h, digests AS d FROM {base}
  UNION ALL SELECT key, h + 1, list_transform(range((len(d) + 2) // 3),
    lambda k: sha256(array_to_string(d[3 * k + 1:3 * k + 3], ''))) FROM {name} WHERE len(d) > 1)"""  # noqa: E731
    flat = lambda name, base: f"""{name} AS (SELECT key, h, len(d) AS n, unnest(d) AS d,
  unnest(range(len(d))) AS pos FROM {base})"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")}
    ELSE {leaf('text')} END AS start FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
g AS (SELECT key, list(leaf ORDER BY pos) AS digests FROM p GROUP BY key),
{up('low', 'g')},
s AS (SELECT key, d[1] AS subroot, h AS top, row_number() OVER (ORDER BY key) - 1 AS nth FROM low WHERE len(d) = 1),
t AS (SELECT 'all' AS key, list(subroot ORDER BY nth) AS digests FROM s HAVING count(*) > 0),
{up('high', 't')},
{flat('a', 'low')}, {flat('b', 'high')},
-- every node of either tree with the digests left and right of it in its run
nodes AS (SELECT x.key, x.h, x.pos, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS "left",
    coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS "right"
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) y
    ON x.key = y.key AND x.h = y.h AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
walk AS (SELECT r, p.key, p.key AS source, 0 AS h, pos, start AS digest, '' AS proof, top, nth FROM p JOIN s USING (key)
  UNION ALL SELECT r, n.key, source, w.h + 1, w.pos // 3, sha256("left" || digest || "right"),
    proof || "left" || "right", top, nth
  FROM (SELECT r, CASE WHEN key <> 'all' AND h = top THEN 'all' ELSE key END AS key, source,
      CASE WHEN key <> 'all' AND h = top THEN 0 ELSE h END AS h,
      CASE WHEN key <> 'all' AND h = top THEN nth ELSE pos END AS pos, digest, proof, top, nth FROM walk) w
  JOIN nodes n ON n.key = w.key AND n.h = w.h AND n.pos = w.pos),
e AS (SELECT r, last(digest ORDER BY key = 'all', h) AS folded_root,
  last(proof ORDER BY key = 'all', h) AS proof FROM walk GROUP BY r),
root AS (SELECT d[1] AS root FROM high WHERE len(d) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN e USING (r) JOIN s USING (key), root"""


SQL = _sql()
