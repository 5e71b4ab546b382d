"""Secret scans with multipart credential linking (SQL functions only).

Base spans of three kinds are found by pattern in every whole text.  Weak
parts (identifiers that name an account, high-entropy values, endpoints) are
worth reporting only together: a weak part becomes a span when its complement
starts within ``SCOPE`` code points of it in the same document:

* a weak access identifier needs a secret (any kind),
* a weak secret needs an access identifier (strong or weak),
* an endpoint needs both.

No token completes itself: a weak part that overlaps a part of a surer kind
(base, then weak access, endpoint, weak secret) is no part.

The join is an interval join on scope bins: parts are reduced to the least and
greatest start per (document, bin, role) before they meet, so a weak part
looks at three bins and no pairs of parts are ever listed.

Offsets are code points, end exclusive.  SQL has no function for match
positions, so they come from the lengths of the pieces between the matches
(``split``) and of the matches, by a two-level prefix sum inside the row.

Defined cases: a null text counts as empty (no spans); rows that agree in id
and text get the same spans, each row is returned; rows with a null id are
kept; parts of different rows with the same id but another text never link; an
empty table has no rows; other columns, whatever their names, are kept by
``redact`` and not read; long texts are scanned whole, and their parts are compared
in order of place, not each with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parindex.llm.common import cut, fresh, table, text_or_empty


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "|".join(_either_case(w) for w in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, role, pattern, condition on the match m and on group 2 as g2 (SQL), base kind
KINDS: tuple[tuple[str, str, str, str, bool], ...] = (
    ("assign", "secret", f"({_names('password', 'passwd', 'secret', 'token', 'api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)",
     "length(g2) >= 8", True),
    ("access", "access", r"AKIA[A-Z0-9]{12,}", "true", True),
    ("hex", "secret", r"[0-9a-f]{32,}", "true", True),
    ("weak_access", "access",
     f"({_names('access_?key_?id', 'client_?id', 'username', 'user', 'login', 'account')}){_SET}([A-Za-z0-9._@-]+)",
     "length(g2) >= 3", False),
    ("weak_secret", "secret", r"[A-Za-z0-9+/_-]{20,}",
     "regexp_like(m, '[0-9]') AND regexp_like(m, '[a-z]') AND regexp_like(m, '[A-Z]')", False),
    ("endpoint", "endpoint", r"""[hH][tT][tT][pP][sS]?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}""",
     "true", False),
)
#: index into KINDS -> how sure the kind is (0 first); of overlapping parts the surer one counts
SURENESS = (0, 0, 0, 1, 3, 2)
SCOPE = 256
_BLOCK = 256


def _starts(pieces: Column, matches: Column) -> Column:
    """0-based start of every match; two-level prefix sums keep it near-linear."""
    lens = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    n = F.size(matches)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                         lambda b: total(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))
    upto = lambda i: (total(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int")))
                      + total(F.slice(lens, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
                      + F.length(F.get(pieces, i)))
    return F.transform(F.sequence(F.lit(0), n - 1), upto)


def _spans(text: Column, k: int) -> Column:
    """Spans of one kind as array<struct<start, k, end>>; empty where nothing matches."""
    _, _, pattern, rule, _ = KINDS[k]
    p = F.lit(pattern)
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    # one element per match: its start, its end and the values its condition reads
    found = F.arrays_zip(_starts(pieces, matches).alias("s"), matches.alias("m"),
                         (F.regexp_extract_all(text, p, F.lit(2)) if "g2" in rule else matches).alias("g"))
    if "g2" in rule:
        good = F.filter(found, lambda x: F.length(x["g"]) >= int(rule.rsplit(" ", 1)[1]))
    elif rule != "true":
        good = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]"))
    else:
        good = found
    spans = F.transform(good, lambda x: F.struct(
        x["s"].alias("start"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("end")))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def surest(parts: DataFrame) -> DataFrame:
    """``parts`` (key, k, start, end; each once) without the weak ones that overlap a surer part.

    Two passes in order of place: the furthest end of each kind of sureness
    before a part, the nearest start of each after it."""
    sure = F.get(F.array(*[F.lit(x) for x in SURENESS]), F.col("k"))
    parts = parts.withColumn("sure", sure)
    so_far = lambda *order: (Window.partitionBy("key").orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, -1))
    ahead = so_far("start", "k", "end")
    behind = so_far(F.desc("start"), F.desc("k"), F.desc("end"))
    for x in range(max(SURENESS)):
        of = lambda c, x=x: F.when(F.col("sure") == x, F.col(c))
        parts = parts.withColumns({f"to{x}": F.max(of("end")).over(ahead), f"from{x}": F.min(of("start")).over(behind)})
    covered = F.lit(False)
    for x in range(max(SURENESS)):
        covered |= (F.col("sure") > x) & (F.coalesce(F.col(f"to{x}") > F.col("start"), F.lit(False))
                                          | F.coalesce(F.col(f"from{x}") < F.col("end"), F.lit(False)))
    return parts.filter(~covered).select("key", "k", "start", "end")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts whose complement starts within ``scope`` of them.

    ``parts``: ``key`` (any type), ``k`` (index into KINDS), ``start``, ``end``.
    Returns the reported weak rows, once each.
    """
    roles = F.array(*[F.lit(k[1]) for k in KINDS])
    parts = parts.select("key", "k", "start", "end", F.get(roles, F.col("k")).alias("role"),
                         F.floor(F.col("start") / scope).alias("bin")).distinct()
    seen = parts.filter("role <> 'endpoint'").groupBy("key", "bin", "role").agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"))
    near = (seen.select("key", "role", "lo", "hi", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("d"), "bin")
            .withColumn("bin", F.col("bin") + F.col("d")))
    pick = lambda role, d, v: F.max(F.when((F.col("role") == role) & (F.col("d") == d), F.col(v)))
    # d = 1: the bin before the part's own (its last start counts), d = -1: the bin after
    near = near.groupBy("key", "bin").agg(*[
        pick(role, d, v).alias(f"{role}_{name}") for role in ("access", "secret")
        for name, d, v in (("own", 0, "lo"), ("before", 1, "hi"), ("after", -1, "lo"))])
    has = lambda role: (F.col(f"{role}_own").isNotNull()
                        | F.coalesce(F.col(f"{role}_before") >= F.col("start") - scope, F.lit(False))
                        | F.coalesce(F.col(f"{role}_after") <= F.col("start") + scope, F.lit(False)))
    weak = parts.filter(F.col("k") >= sum(k[4] for k in KINDS))
    return (weak.join(near, ["key", "bin"])
            .filter(((F.col("role") == "access") & has("secret"))
                    | ((F.col("role") == "secret") & has("access"))
                    | ((F.col("role") == "endpoint") & has("access") & has("secret")))
            .select("key", "k", "start", "end"))


def row_key(id_col: str, text: Column) -> Column:
    """Rows that agree in id and text share a key; the text itself is not kept."""
    return F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("h"),
                    F.length(text).alias("n"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 scope: int = SCOPE) -> DataFrame:
    """Per row: the id, ``key`` (see ``row_key``), ``base`` and ``spans``: sorted
    arrays of struct<start, k, end>, k being the index into ``KINDS``."""
    src = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("t"))
    t = F.col("t")
    n_base = sum(k[4] for k in KINDS)
    found = src.select(id_col, row_key(id_col, t).alias("key"),
                       F.sort_array(F.concat(*[_spans(t, k) for k in range(n_base)])).alias("base"),
                       F.concat(*[_spans(t, k) for k in range(n_base, len(KINDS))]).alias("weak"))
    found = cut(found)
    parts = (found.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
             .select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.*").distinct())
    linked = (link_parts(surest(parts), scope)
              .groupBy("key").agg(F.collect_list(F.struct("start", "k", "end")).alias("more")))
    found = found.select(id_col, "key", "base").join(linked, "key", "left")
    return found.select(id_col, "key", "base", F.sort_array(F.concat(
        "base", F.coalesce("more", F.array().cast("array<struct<start:int,k:int,end:int>>")))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span (base and linked) replaced by ``mark``.

    All columns and rows are kept; a null text stays null."""
    key, spans, k2 = fresh(docs, "s_key", "s_spans", "s_key2")
    found = (scan_secrets(docs, id_col, text_col, scope).filter(F.size("spans") > 0)
             .groupBy("key").agg(F.first("spans").alias(spans)).withColumnRenamed("key", k2))
    out = docs.withColumn(key, row_key(id_col, text_or_empty(text_col)))
    out = out.join(found, F.col(key).eqNullSafe(F.col(k2)), "left")
    text = F.col(text_col)
    done = F.aggregate(
        F.col(spans), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
            s["end"].alias("at"))).otherwise(F.struct(
                acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return out.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(done)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
                        _line(F.col("spans")).alias("spans"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    parts = []
    for k, (_, role, pattern, rule, _) in enumerate(KINDS):
        rule = rule.replace("regexp_like", "regexp_matches").replace(
            "g2", f"regexp_extract(m, '{quote(pattern)}', 2)")
        parts.append(f"""SELECT r, {k} AS k, '{role}' AS role, s AS "start", s + length(m) AS "end" FROM (
  SELECT r, m, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT
             + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT r, ps, ms, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, string_split_regex(t, '{quote(pattern)}') AS ps,
           regexp_extract_all(t, '{quote(pattern)}') AS ms FROM d))) WHERE {rule}""")
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    near = lambda role: (f"EXISTS (SELECT 1 FROM p q WHERE q.r = w.r AND q.role = '{role}' "  # noqa: E731
                         f"AND (q.\"start\" // {SCOPE} = w.\"start\" // {SCOPE} "
                         f"OR abs(q.\"start\" - w.\"start\") <= {SCOPE}))")
    sure = list(SURENESS)
    line = f"""{names}[k + 1] || ':' || "start" || ':' || "end\""""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
p AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND {sure}[y.k + 1] < {sure}[x.k + 1]
      AND y."start" < x."end" AND x."start" < y."end")),
w AS (SELECT * FROM p w WHERE k < 3 OR (role = 'access' AND {near('secret')})
      OR (role = 'secret' AND {near('access')})
      OR (role = 'endpoint' AND {near('access')} AND {near('secret')})),
o AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
        string_agg({line}, ',' ORDER BY "start", k, "end") FILTER (k < 3) AS base,
        string_agg({line}, ',' ORDER BY "start", k, "end") AS spans FROM w GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access,
  coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)"""


SQL = _sql()
