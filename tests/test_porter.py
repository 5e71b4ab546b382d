"""Porter lexemes as column expressions: examples from the published description
of the algorithm, and a plain word-by-word version on random words."""

import random

import duckdb
import pytest

from parindex.functions.porter import STEP2, STEP3, STEP4, lexeme_ctes, lexemes
from parindex.operators import dictionary

CASES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform",
    "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "generalizations": "gener", "oscillators": "oscil",
}


_VOWELS = set("aeiou")


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _is_cons(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _longest(word: str, rules):
    best = None
    for suf, rep in rules:
        if word.endswith(suf) and (best is None or len(suf) > len(best[0])):
            best = (suf, rep)
    return best


def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2 and 3
    for rules in (STEP2, STEP3):
        hit = _longest(w, rules)
        if hit and _measure(w[:-len(hit[0])]) > 0:
            w = w[:-len(hit[0])] + hit[1]
    # step 4
    hit = _longest(w, [(s, "") for s in STEP4])
    if hit:
        base = w[:-len(hit[0])]
        if _measure(base) > 1 and (hit[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    # step 5a
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _cvc(base)):
            w = base
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def random_words():
    rnd = random.Random(8)
    ends = [s for s, _ in STEP2 + STEP3] + STEP4 + ["s", "ed", "ing", "eed", "y", "e", "ll", "sses", "ies", "at", "tt"]
    words = ["", "y", "yy", "ayyy", "xyyyed", "étés", "3.5", "a", "is", "o'neil"]
    for _ in range(6000):
        body = "".join(rnd.choices("aeioubcdlstxyzwé", k=rnd.randrange(7)))
        words.append(body + "".join(rnd.choices(ends, k=rnd.randrange(3))))
    return sorted({*words, *CASES})


def test_published_examples_and_plain_version(spark):
    words = random_words()
    df = spark.createDataFrame([(w, len(w)) for w in words], "term string, n int")
    got = {r.term: (r.lexeme, r.n) for r in lexemes(df).collect()}
    assert all(got[w][0] == want for w, want in CASES.items())
    assert got == {w: (stem(w), len(w)) for w in words}


def test_oracle_ctes_give_the_same(spark):
    words = random_words()
    con = duckdb.connect()
    con.execute("CREATE TABLE w (term VARCHAR)")
    con.executemany("INSERT INTO w VALUES (?)", [(w,) for w in words[:1500]])
    rows = con.execute("WITH " + lexeme_ctes("SELECT term FROM w", "lex") + " SELECT * FROM lex").fetchall()
    assert dict(rows) == {w: stem(w) for w in words[:1500]}


def test_lexemes_of_a_query_column_stay_local(spark):
    from parindex.functions.sizing import is_local
    from parindex.operators.tsv import lexeme_queries
    q = spark.createDataFrame([(1, "hopping"), (2, None)], "query_id int, stem string")
    assert [tuple(r) for r in lexeme_queries(q).collect()] == [(1, "hop"), (2, None)]
    assert is_local(lexeme_queries(q)) == is_local(q)


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_heavy_terms_join_without_a_shuffle(spark, share):
    rows = [("hot", i) for i in range(400)] + [(f"t{i % 50}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "term string, section_id int")
    words = spark.createDataFrame([("hot", 7, 400)] + [(f"t{i}", i, 12) for i in range(50)], "term string, id int, n long")
    got = dictionary.attach(df, words, share=share).collect()
    assert sorted((r.term, r.section_id, r.id) for r in got) == sorted(
        (t, i, 7 if t == "hot" else int(t[1:])) for t, i in rows)
