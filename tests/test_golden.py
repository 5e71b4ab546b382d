"""Scores of a small corpus of our own against plain Python versions of the formulas."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from parindex.functions import proximity as P
from parindex.operators import index as D
from parindex.operators import rank as R
from parindex.operators import search as Q
from parindex.plans.querytable import query_table

SECTIONS = [
    "lantern keeper watched grey storm near harbour wall",
    "harbour pilot sold rope",
    "storm broke lantern glass storm took lantern oil away harbour lit",
    "quiet ferry captain drinks coffee inside",
    "keeper found another lantern",
]
WORDS = [s.split() for s in SECTIONS]
N, AVG = len(WORDS), sum(map(len, WORDS)) / len(WORDS)
TERMS = ("lantern", "storm")


def df(term):
    return sum(term in w for w in WORDS)


def places(section, terms=TERMS):
    return {t: [i + 1 for i, w in enumerate(WORDS[section]) if w == t] for t in terms if t in WORDS[section]}


def tfidf(section):
    return sum((1 + math.log10(len(p))) * math.log10(N / df(t)) for t, p in places(section).items())


def bm25(section, k1=1.7, b=0.75):
    norm = k1 * (1 - b + b * len(WORDS[section]) / AVG)
    return sum(math.log10(1 + (N - df(t) + 0.5) / (df(t) + 0.5)) * len(p) * (k1 + 1) / (len(p) + norm)
               for t, p in places(section).items())


def tfidf_ext(section, as_written=False):
    lists = list(places(section).values())
    if len(lists) < 2:
        return tfidf(section)
    dist, span = _brute(lists)
    near = len(lists) ** 2 if as_written else (len(lists) / span) ** 2
    return tfidf(section) + (dist + near) / sum(map(len, lists))


HITS = [s for s in range(N) if places(s)]


@pytest.fixture(scope="module")
def idx(spark):
    corpus = spark.createDataFrame([(0, "harbour", "\n\n".join(SECTIONS))], "doc_id long, title string, doc string")
    return D.build_index(corpus, sep="\n\n")


def ranked(spark, idx, method, **kw):
    q = query_table(spark, {1: " OR ".join(TERMS)})
    rows = R.rank(idx, q, method, 10, **kw).orderBy("rank").collect()
    return [(r.section_id, r.score) for r in rows]


def test_sections_and_stats(idx):
    assert {r.section_id: r.num_words for r in idx.sections.collect()} == dict(enumerate(map(len, WORDS)))
    st = D.rank_vars(idx.sections).first()
    assert (st.num_secs, st.num_words_secs) == (N, sum(map(len, WORDS)))
    assert st.avg_sec_len == pytest.approx(AVG)


def test_idf(idx):
    idf = {r.stem: r for r in idx.idf().collect()}
    for t in ("lantern", "storm", "harbour", "keeper", "rope"):
        assert idf[t].df == df(t)
        assert idf[t].idf == pytest.approx(math.log10(N / df(t)), abs=1e-6)
        assert idf[t].bm25idf == pytest.approx(math.log10(1 + (N - df(t) + 0.5) / (df(t) + 0.5)), abs=1e-6)


SCORES = {
    "tfidf": tfidf,
    "tfidf_doclen": lambda s: tfidf(s) / math.sqrt(len(WORDS[s])),
    "bm25": bm25,
    "tfidf_ext": tfidf_ext,
}


@pytest.mark.parametrize("method", sorted(SCORES))
def test_rankings(spark, idx, method):
    want = sorted(((round(SCORES[method](s), 6), s) for s in HITS), reverse=True)
    got = ranked(spark, idx, method)
    assert [s for s, _ in got] == [s for _, s in want]
    for (_, a), (b, _) in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6)


def test_bm25_ext_adds_proximity_only_to_pairs(spark, idx):
    for s, score in ranked(spark, idx, "bm25_ext"):
        plain = bm25(s, 1.2, 0.9)
        if len(places(s)) < 2:
            assert score == pytest.approx(plain, abs=2e-6)
        else:
            assert score > plain


def test_span_as_written(spark, idx):
    for s, score in ranked(spark, idx, "tfidf_ext", span_mode="as_written"):
        assert score == pytest.approx(tfidf_ext(s, as_written=True), abs=2e-6)


def test_boolean(spark, idx):
    def hits(text, unknown="drop"):
        q = query_table(spark, {1: text})
        return sorted(r.section_id for r in Q.search(idx, q, unknown).collect())
    has = lambda t: {s for s in range(N) if t in WORDS[s]}
    assert hits("lantern AND storm") == sorted(has("lantern") & has("storm"))
    assert hits("(lantern OR rope) AND (harbour)") == sorted((has("lantern") | has("rope")) & has("harbour"))
    assert hits("lantern AND zebra") == sorted(has("lantern"))
    assert hits("lantern AND zebra", "empty") == []
    assert hits("zebra") == []
    assert hits("(pilot AND rope) OR (keeper AND storm)") == sorted(
        has("pilot") & has("rope") | has("keeper") & has("storm"))


def test_rerank_two_stage(spark, idx):
    q = query_table(spark, {1: " OR ".join(TERMS)})
    rows = R.rerank_two_stage(idx, q, k=2).orderBy("rank").collect()
    first = sorted(HITS, key=lambda s: (-SCORES["tfidf_doclen"](s), -s))[:2]
    assert [r.section_id for r in rows] == sorted(first, key=lambda s: (-tfidf_ext(s), -s))


def _lists_df(spark, lists):
    rows = [(i, [(k, sorted(l), 0.0, 0.0) for k, l in enumerate(ls)]) for i, ls in enumerate(lists)]
    return spark.createDataFrame(
        rows, "id int, lists array<struct<k:int, offsets:array<int>, bm25idf:double, idf:double>>")


def _prox(spark, lists):
    df = _lists_df(spark, lists)
    n = F.size("lists")
    fold = P.proximity_fold(F.col("lists"))
    out = df.select("id", P.min_dist_sum(fold, n).alias("md"), P.least_span(fold, n).alias("span"),
                    P.min_span_score(fold, n).alias("ms")).orderBy("id").collect()
    return [(r.md, r.span, r.ms) for r in out]


def test_proximity_of_given_lists(spark):
    cases = [[[4, 17, 30], [9, 22]], [[3], [14, 40], [21, 25, 33]], [[8, 50], [12], [19], [60, 61]]]
    for lists, (md, span, score) in zip(cases, _prox(spark, cases)):
        dist, least = _brute(lists)
        assert md == pytest.approx(dist) and span == least
        assert score == pytest.approx((len(lists) / least) ** 2)
    (md, _, score), = _prox(spark, [[[6, 13]]])
    assert md == 0.0 and score == 0.0


def _brute(lists):
    md = 0.0
    for a, b in itertools.combinations(lists, 2):
        md += 1.0 / min(abs(p - q) for p in a for q in b) ** 2
    span = min(max(c) - min(c) for c in itertools.product(*lists))
    return md, span


def test_fold_equals_cross_product(spark):
    rnd = random.Random(1)
    cases = []
    for _ in range(300):
        n = rnd.randint(2, 4)
        pos = rnd.sample(range(1, 40), n * 4)
        lists, i = [], 0
        for _ in range(n):
            m = rnd.randint(1, 4)
            lists.append(sorted(pos[i:i + m]))
            i += m
        cases.append(lists)
    got = _prox(spark, cases)
    for lists, (md, span, _) in zip(cases, got):
        bmd, bspan = _brute(lists)
        assert md == pytest.approx(bmd)
        assert span == bspan


def test_pair_distance(spark):
    df = spark.createDataFrame([([1, 9], [4, 20]), ([3], None)], "a array<int>, b array<int>")
    got = [r.d for r in df.select(P.pair_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [3, -1]
