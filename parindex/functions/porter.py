"""Porter (1980) suffix stripping as a cascade of column expressions.

Runs on the *distinct* terms of an index.  Each step is one projection over the
word ``w`` and its ``marks``: the word with every consonant ``y`` (at the start
or after a vowel) written ``Y``, so that vowels are ``[aeiouy]`` and the measure of a stem, the number of
vowel-consonant sequences, is a pattern search in a prefix of the marks.  The
steps are SQL text in the few functions that Spark and other engines share, so
one rule table serves the plan and its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]

_SOME = "[aeiouy][^aeiouy]"                                # measure above 0
_MORE = "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"             # measure above 1
_SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$"              # consonant, vowel, consonant other than w, x, y

#: pattern test, and how a word is marked
DIALECTS = {
    "spark": ("regexp_like", "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '$1Y')"),
    "duckdb": ("regexp_matches", "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"),
}


def steps(dialect: str = "spark") -> list[dict[str, str]]:
    """Per step the new columns, as SQL over ``w``, ``marks``, ``term`` and ``again``."""
    test = DIALECTS[dialect][0]
    has = lambda pattern, x: f"{test}({x}, '{pattern}')"
    cut = lambda x, n: f"left({x}, length({x}) - {n})"
    ends = lambda s: f"right(w, {len(s)}) = '{s}'"
    case = lambda *pairs: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " ELSE w END"

    def longest(rules, measure, only=None):
        """The longest ending decides; it is replaced if what stands before it measures enough."""
        out = []
        for suffix, put in sorted(rules, key=lambda r: -len(r[0])):
            n, ok = len(suffix), has(measure, cut("marks", len(suffix)))
            if only and suffix in only:
                ok += f" AND right({cut('w', n)}, 1) IN ({only[suffix]})"
            out.append((ends(suffix), f"CASE WHEN {ok} THEN {cut('w', n)} || '{put}' ELSE w END"))
        return case(*out)

    vowel_before = lambda n: has("[aeiouy]", cut("marks", n))
    double = "length(w) >= 2 AND right(w, 1) = left(right(w, 2), 1) AND NOT " + has("[aeiouy]", "right(marks, 1)")
    past, going = f"({ends('ed')} AND {vowel_before(2)})", f"({ends('ing')} AND {vowel_before(3)})"
    return [
        {"w": case(("length(w) <= 2", "w"), (ends("sses"), cut("w", 2)), (ends("ies"), cut("w", 2)), (ends("ss"), "w"),
                   (ends("s"), cut("w", 1)))},
        {"w": case((ends("eed"), f"CASE WHEN {has(_SOME, cut('marks', 3))} THEN {cut('w', 1)} ELSE w END"),
                   (past, cut("w", 2)), (going, cut("w", 3))),
         "again": f"NOT {ends('eed')} AND ({past} OR {going})"},
        {"w": case(("NOT again", "w"), ("right(w, 2) IN ('at', 'bl', 'iz')", "w || 'e'"),
                   (f"{double} AND right(w, 1) NOT IN ('l', 's', 'z')", cut("w", 1)),
                   (f"{has(_SOME, 'marks')} AND NOT {has(_MORE, 'marks')} AND {has(_SHORT_END, 'marks')}", "w || 'e'"))},
        {"w": case((f"{ends('y')} AND {vowel_before(1)}", cut("w", 1) + " || 'i'"))},
        {"w": longest(STEP2, _SOME)},
        {"w": longest(STEP3, _SOME)},
        {"w": longest([(s, "") for s in STEP4], _MORE, {"ion": "'s', 't'"})},
        {"w": case((f"{ends('e')} AND ({has(_MORE, cut('marks', 1))} OR ({has(_SOME, cut('marks', 1))} "
                    f"AND NOT {has(_SHORT_END, cut('marks', 1))}))", cut("w", 1)))},
        {"w": case((f"{ends('ll')} AND {has(_MORE, 'marks')}", cut("w", 1)))},
        {"w": "CASE WHEN length(term) <= 2 THEN term ELSE w END"},
    ]


def lexemes(terms: DataFrame, term: str = "term", out: str = "lexeme") -> DataFrame:
    """``terms`` with ``out``: the lexeme of the word in column ``term`` (null stays null)."""
    others = [c for c in terms.columns if c not in (term, out)]
    rows = terms.select(F.struct(*others or [F.lit(0)]).alias("others"), F.col(term).alias("term"),
                        F.col(term).alias("w"), F.lit(False).alias("again"))
    for step in steps("spark"):
        rows = rows.selectExpr("others", "term", "w", "again", f"{DIALECTS['spark'][1]} AS marks")
        rows = rows.selectExpr("others", "term", f"{step['w']} AS w", f"{step.get('again', 'again')} AS again")
    return rows.select(*[F.col("others")[c].alias(c) for c in others],
                       *([F.col("term").alias(term)] if out != term else []), F.col("w").alias(out))


_RULES = [(sorted(rules, key=lambda r: -len(r[0])), tuple(s for s, _ in rules), measure) for rules, measure in (
    (STEP2, _SOME), (STEP3, _SOME), ([(s, "") for s in STEP4], _MORE))]


def porter_word(term: str) -> str:
    """One word through the same cascade, for tasks that hold a batch's distinct terms."""
    if len(term) <= 2:
        return term
    w = term

    def has(pattern, n=0):
        marks = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
        return re.search(pattern, marks[:len(marks) - n]) is not None

    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if has(_SOME, 3) else w
    elif (w.endswith("ed") and has("[aeiouy]", 2)) or (w.endswith("ing") and has("[aeiouy]", 3)):
        w = w[:-2] if w.endswith("ed") else w[:-3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) >= 2 and w[-1] == w[-2] and w[-1] not in "lsz" and not has("[aeiouy]$"):
            w = w[:-1]
        elif has(_SOME) and not has(_MORE) and has(_SHORT_END):
            w += "e"
    if w.endswith("y") and has("[aeiouy]", 1):
        w = w[:-1] + "i"
    for rules, endings, measure in _RULES:
        if not w.endswith(endings):  # one test for most words
            continue
        suffix, put = next(((s, p) for s, p in rules if w.endswith(s)), ("", ""))
        n = len(suffix)
        if n and has(measure, n) and (suffix != "ion" or rules is not _RULES[2][0] or w[:-n].endswith(("s", "t"))):
            w = w[:-n] + put
    if w.endswith("e") and (has(_MORE, 1) or (has(_SOME, 1) and not has(_SHORT_END, 1))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and has(_MORE) else w


def lexeme_ctes(source: str, name: str) -> str:
    """DuckDB: CTEs that end in ``name(term, lexeme)``; ``source`` selects the distinct terms."""
    mark = DIALECTS["duckdb"][1]
    parts = [f"{name}_0 AS (SELECT term, term AS w, false AS again FROM ({source}))"]
    for k, step in enumerate(steps("duckdb")):
        parts.append(f"{name}_{k + 1} AS (SELECT term, {step['w']} AS w, {step.get('again', 'again')} AS again "
                     f"FROM (SELECT *, {mark} AS marks FROM {name}_{k}))")
    parts.append(f"{name} AS (SELECT term, w AS lexeme FROM {name}_{len(parts) - 1})")
    return ",\n".join(parts)
