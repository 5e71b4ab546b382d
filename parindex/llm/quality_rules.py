"""Quality rules as a bitmask ledger (SQL functions only).

``ledger`` measures every text once and evaluates every rule once: rule ``i``
sets bit ``i`` of ``failed_bits`` when it fails.  Policies are versioned masks
over those bits (``apply_policy``), so another policy or an ablation
(``ablations``) never touches the texts again: it counts rows per distinct bit
mask and combines the few masks bitwise.

Defined cases: a null text counts as empty (no words, fails ``few_words``);
rows are judged one by one, so repeated rows give repeated results; columns of
the input other than the text are carried unchanged by ``ledger``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import BLANKS, WORD_BREAK, fresh, table, text_or_empty

#: rule i fails -> bit i; SQL over the measurements, integers only
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "10 * n_upper > 4 * word_chars"),
    ("very_long", "n_words > 1000000"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: versions of the policy: the rules that decide
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": BASE_RULES + ("short_words", "long_words", "symbols"),
    "v2": BASE_RULES + ("short_words", "long_words", "symbols", "shouting"),
    "strict": BASE_RULES + ("short_words", "long_words", "symbols", "shouting", "repeated_lines",
                            "very_long"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper")
_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(_BIT[r] for r in set(rules))


def _repeat_positions(ranked: Column) -> Column:
    """Starts of the windows whose value occurs twice; ``ranked`` is sorted by value."""
    twice = F.filter(ranked, lambda s, k: F.coalesce(s["w"] == F.get(ranked, k - 1)["w"], F.lit(False))
                     | F.coalesce(s["w"] == F.get(ranked, k + 1)["w"], F.lit(False)))
    return F.transform(twice, lambda s: s["i"])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input columns, the measurements and ``failed_bits``.

    Repeated three-word windows are found inside the row: windows are hashed
    (64 bit), and only texts in which two hashes agree are sorted.
    """
    t, words, n, win, ranked, pos, lines = fresh(
        docs, "q_text", "q_words", "q_n", "q_windows", "q_ranked", "q_pos", "q_lines")
    trimmed = F.trim(text_or_empty(text_col), F.lit(BLANKS))
    out = docs.withColumn(t, trimmed)
    out = out.withColumn(words, F.when(F.col(t) == "", F.array().cast("array<string>"))
                         .otherwise(F.split(t, WORD_BREAK)))
    out = out.withColumn(n, F.size(words))
    w = F.col(words)
    out = out.withColumn(win, F.when(F.col(n) >= 3, F.transform(
        F.sequence(F.lit(0), F.col(n) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    out = out.withColumn(ranked, F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    out = out.withColumn(pos, _repeat_positions(F.col(ranked)))
    p = F.col(pos)
    covered = F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)),
                            F.transform(p, lambda i: i + 2))
    body = text_or_empty(text_col)
    out = out.withColumn(lines, F.filter(
        F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    measures = {
        "n_words": F.col(n).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
    }
    keep = [c for c in docs.columns if c.lower() not in {*MEASURES, "failed_bits"}]
    out = out.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in measures.items()])
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(_BIT[name])).otherwise(0).cast("long"))
    return out.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` by one mask each; reads no text.

    Every policy holds the base rules, so what fails them is never kept."""
    bits = F.col("failed_bits")
    return rows.withColumns({
        "base_failed": bits.bitwiseAND(F.lit(mask_of(BASE_RULES))) != 0,
        "kept": bits.bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0,
    })


def ablations(rows: DataFrame) -> DataFrame:
    """For every policy and rule in it: rows dropped by the policy, rows that
    fail the rule, rows that fail no other rule of the policy (they would be
    kept without it).  One count per distinct mask, then bitwise tests."""
    pairs = [(v, r, mask_of(rs), _BIT[r]) for v, rs in POLICIES.items() for r in rs]
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("failed_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    arms = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"),
                              F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"))
                     for v, r, m, b in pairs])
    return (counts.select("failed_bits", "n", F.explode(arms).alias("a"))
            .select("failed_bits", "n", "a.*")
            .groupBy("policy", "rule")
            .agg(total(failed != 0).alias("dropped"),
                 total(failed.bitwiseAND(F.col("bit")) != 0).alias("failed_rule"),
                 total(failed == F.col("bit")).alias("only_this_rule")))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_upper", "failed_bits")


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """Every policy's rules over ``documents``: what each drops, alone and together with the others."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("text")))


def _ablations_sql() -> str:
    """One scan of the ledger per policy and rule."""
    arms = " UNION ALL ".join(
        f"""
SELECT '{v}' AS policy, '{r}' AS rule, coalesce(sum((failed_bits & {mask_of(rs)} <> 0)::INT), 0)::BIGINT AS dropped,
  coalesce(sum((failed_bits & {_BIT[r]} <> 0)::INT), 0)::BIGINT AS failed_rule,
  coalesce(sum((failed_bits & {mask_of(rs)} = {_BIT[r]})::INT), 0)::BIGINT AS only_this_rule FROM o"""
        for v, rs in POLICIES.items() for r in rs)
    return f"WITH o AS ({_sql()}) {arms}"


def _sql() -> str:
    bits = " | ".join(f"(CASE WHEN {rule} THEN {_BIT[name]} ELSE 0 END)" for name, rule in RULES)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gg AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM gg) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {mask_of(BASE_RULES)}) <> 0 AS base_failed,
  (failed_bits & {mask_of(POLICIES["v2"])}) = 0 AS kept, n_lines, n_upper, failed_bits FROM f"""


SQL = _sql()
ABLATIONS_SQL = _ablations_sql()
