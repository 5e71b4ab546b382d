"""DuckDB SQL for the correctness oracle.

The SQL re-derives every table from the driver's views (``documents`` …) with
plain joins, GROUP BY/HAVING and window functions — an independent route to
the same answers.  Fixed values (characters, punctuation, stop words, token
pattern) come from :mod:`parindex.functions.text` so both engines read the
same constants.
"""

from __future__ import annotations

from parindex.functions import text as tx
from parindex.functions.porter import lexeme_ctes
from parindex.operators.index import BM25_B, BM25_EXT_B, BM25_EXT_K1, BM25_K1
from parindex.plans.querytable import parse_query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLEAN = f"translate({{x}}, {lit(tx.CLEAN_CHARS)}, {lit(' ' * len(tx.CLEAN_CHARS))})"
STOPS = "(" + ", ".join(lit(w) for w in tx.STOP_WORDS_EN) + ")"


def words_expr(col: str, lower: bool = True) -> str:
    text = CLEAN.format(x=col)
    if lower:
        text = f"lower({text})"
    return (f"list_filter(regexp_extract_all({text}, {lit(tx.TOKEN_PATTERN)}), "
            f"lambda w: NOT contains({lit(tx.PUNCTUATION)}, w))")


def s_stem(t: str) -> str:
    return (f"CASE WHEN suffix({t}, 'ies') AND NOT suffix({t}, 'eies') AND NOT suffix({t}, 'aies') "
            f"THEN substr({t}, 1, length({t}) - 3) || 'y' "
            f"WHEN suffix({t}, 'es') AND NOT suffix({t}, 'aes') AND NOT suffix({t}, 'ees') "
            f"AND NOT suffix({t}, 'oes') THEN substr({t}, 1, length({t}) - 1) "
            f"WHEN suffix({t}, 's') AND NOT suffix({t}, 'us') AND NOT suffix({t}, 'ss') "
            f"AND length({t}) > 1 THEN substr({t}, 1, length({t}) - 1) ELSE {t} END")


CONVERSATION_SECTIONS = """
corpus AS (SELECT DISTINCT conv_id AS doc_id, 'doc-' || CAST(conv_id AS VARCHAR) AS title FROM conversations),
sections0 AS (
  SELECT conv_id * 1048576 + turn AS section_id, conv_id AS doc_id, turn AS para_idx, text AS section
  FROM conversations WHERE text IS NOT NULL AND text <> ''),"""


def corpus_ctes(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                sep: str = "\n", lower: bool = True, sections_sql: str | None = None, length: str = "words",
                lemma: str = "s_stemmer", df: str = "sum(n_terms)") -> str:
    """pieces, sections0, words, sections, tokens0, tokens, postings, stats, idf."""
    lexed = ("" if lemma == "s_stemmer" else
             lexeme_ctes(f"SELECT DISTINCT term FROM tokens0 WHERE term NOT IN {STOPS}", "lex") + ",")
    if lemma == "porter":
        stem, lex_join = "lexeme", "JOIN lex USING (term)"
    else:
        stem, lex_join = s_stem("term"), ""
    n_words = {"words": "len(words)", "blank": "n_blank"}[length]
    sep_sql = "chr(10)" if sep == "\n" else lit(sep)
    head = sections_sql if sections_sql is not None else f"""
corpus AS (SELECT {id_col} AS doc_id, 'doc-' || CAST({id_col} AS VARCHAR) AS title, {text_col} AS doc FROM {table}),
pieces AS (
  SELECT doc_id, unnest(parts) AS section, unnest(range(0, len(parts))) AS para_idx
  FROM (SELECT doc_id, string_split(doc, {sep_sql}) AS parts FROM corpus)),
sections0 AS (
  SELECT doc_id * 1048576 + para_idx AS section_id, doc_id, para_idx, section FROM pieces WHERE section <> ''),"""
    return head + f"""
words AS (SELECT section_id, doc_id, {words_expr('section', lower)} AS words,
                 1 + length(section) - length(replace(section, ' ', '')) AS n_blank FROM sections0),
sections AS (
  SELECT section_id, doc_id, CAST({n_words} AS INTEGER) AS num_words,
         CASE WHEN {n_words} = 0 THEN 0.0 ELSE 1.0 / sqrt({n_words}) END AS weight FROM words),
tokens0 AS (
  SELECT section_id, CAST({n_words} AS INTEGER) AS num_words,
         unnest(words) AS term, unnest(range(1, len(words) + 1)) AS "offset" FROM words),
{lexed}
tokens AS (
  SELECT section_id, "offset", term, {stem} AS stem, num_words
  FROM tokens0 {lex_join} WHERE term NOT IN {STOPS}),
postings AS (
  SELECT section_id, stem, count(*) AS tf, count(DISTINCT term) AS n_terms,
         list_sort(list("offset")) AS offsets, max(num_words) AS num_words
  FROM tokens GROUP BY section_id, stem),
stats AS (
  SELECT count(*) AS num_secs, sum(num_words) AS num_words_secs, avg(num_words) AS avg_sec_len FROM sections),
idf AS (
  SELECT stem, df, log10(num_secs / df) AS idf,
         log10(1 + (num_secs - df + 0.5) / (df + 0.5)) AS bm25idf
  FROM (SELECT stem, CAST({df} AS DOUBLE) AS df FROM postings GROUP BY stem), stats)"""


def query_values(queries: dict[int, str], lemma: str = "s_stemmer") -> str:
    """q; with ``lemma="porter"`` its words are lexemes."""
    if lemma == "porter":
        return (query_values(queries).replace("q AS (", "q0 AS (", 1) + ",\n"
                + lexeme_ctes("SELECT DISTINCT stem AS term FROM q0", "qlex") + """,
q AS (SELECT DISTINCT query_id, top_op, group_id, group_op, lexeme AS stem FROM q0 JOIN qlex ON qlex.term = q0.stem)""")
    rows = []
    for qid, text in queries.items():
        for top, gid, gop, stem in parse_query(text):
            rows.append(f"({qid}, {lit(top)}, {gid}, {lit(gop)}, {lit(stem)})")
    return ("q AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(rows) +
            ") t(query_id, top_op, group_id, group_op, stem))")


def queries_from_texts_sql(table: str, id_col: str, text_col: str) -> str:
    """One OR query per row over its analysed words (as ``queries_from_texts``)."""
    return f"""q AS (
  SELECT DISTINCT CAST(query_id AS INTEGER) AS query_id, 'OR' AS top_op, 0 AS group_id, 'OR' AS group_op,
         {s_stem('term')} AS stem
  FROM (SELECT {id_col} AS query_id, unnest({words_expr(text_col)}) AS term FROM {table})
  WHERE term NOT IN {STOPS})"""


def match_ctes(queries: dict[int, str] | None, unknown: str = "drop", q_sql: str | None = None,
               lemma: str = "s_stemmer") -> str:
    """q, qk, groups, matches(query_id, section_id), qs(query_id, stem)."""
    ok = "n_known > 0" if unknown == "drop" else "n_known > 0 AND n_known = n_total"
    return f"""
{q_sql if q_sql is not None else query_values(queries, lemma)},
known AS (SELECT DISTINCT stem FROM postings WHERE stem IN (SELECT stem FROM q)),
qk AS (SELECT q.*, k.stem IS NOT NULL AS known FROM q LEFT JOIN known k USING (stem)),
groups AS (
  SELECT query_id, top_op, group_id, group_op, count(*) AS n_total,
         count(*) FILTER (WHERE known) AS n_known
  FROM qk GROUP BY query_id, top_op, group_id, group_op),
qs AS (SELECT DISTINCT query_id, stem FROM qk WHERE known),
group_hits AS (
  SELECT qk.query_id, p.section_id, qk.group_id, count(DISTINCT p.stem) AS m
  FROM postings p JOIN qk ON qk.stem = p.stem AND qk.known
  GROUP BY qk.query_id, p.section_id, qk.group_id),
group_ok AS (
  SELECT gh.query_id, gh.section_id, gh.group_id
  FROM group_hits gh JOIN groups g USING (query_id, group_id)
  WHERE {ok} AND (g.group_op = 'OR' OR gh.m = g.n_known)),
n_groups AS (SELECT query_id, max(top_op) AS top_op, count(*) AS ng FROM groups GROUP BY query_id),
matches AS (
  SELECT go.query_id, go.section_id
  FROM group_ok go JOIN n_groups n USING (query_id)
  GROUP BY go.query_id, go.section_id, n.top_op, n.ng
  HAVING (n.top_op = 'AND' AND count(*) = n.ng) OR (n.top_op <> 'AND'))"""


def hit_rows_cte() -> str:
    """Per (query, section, stem) rows of matching sections with statistics."""
    return f"""
hit_rows AS (
  SELECT m.query_id, m.section_id, p.stem, p.tf, p.offsets, p.num_words, i.idf, i.bm25idf
  FROM matches m JOIN qs ON qs.query_id = m.query_id
  JOIN postings p ON p.section_id = m.section_id AND p.stem = qs.stem
  JOIN idf i ON i.stem = p.stem),
hit_scores AS (
  SELECT h.query_id, h.section_id, max(h.num_words) AS num_words, sum(h.tf) AS nj,
         sum((1 + log10(h.tf)) * h.idf) AS tfidf,
         sum(((({BM25_K1} + 1) * h.tf) / ({BM25_K1} * ((1 - {BM25_B}) + {BM25_B} * (h.num_words / s.avg_sec_len)) + h.tf)) * h.bm25idf) AS bm25,
         sum(((({BM25_EXT_K1} + 1) * h.tf) / ({BM25_EXT_K1} * ((1 - {BM25_EXT_B}) + {BM25_EXT_B} * (h.num_words / s.avg_sec_len)) + h.tf)) * h.bm25idf) AS bm25_ext
  FROM hit_rows h, stats s GROUP BY h.query_id, h.section_id)"""


def proximity_ctes(span_mode: str = "intended") -> str:
    """Brute-force proximity: all position pairs per pair of stems (min_dist,
    close pairs) and, per window end, the latest position of each stem (span)."""
    span_score = ("CAST(sp.n AS DOUBLE) * sp.n" if span_mode == "as_written"
                  else "1.0 / ((sp.span / sp.n) * (sp.span / sp.n))")
    return f"""
occ AS (SELECT query_id, section_id, stem, unnest(offsets) AS pos FROM hit_rows),
pair_d AS (
  SELECT a.query_id, a.section_id, a.stem AS s1, b.stem AS s2, min(abs(a.pos - b.pos)) AS d
  FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.section_id = b.section_id AND a.stem < b.stem
  GROUP BY a.query_id, a.section_id, a.stem, b.stem),
md AS (
  SELECT pd.query_id, pd.section_id, sum(1.0 / (pd.d * pd.d)) AS min_dist,
         sum(CASE WHEN pd.d < 6 THEN least(i1.bm25idf, i2.bm25idf) ELSE 0 END) AS close_idf
  FROM pair_d pd JOIN idf i1 ON i1.stem = pd.s1 JOIN idf i2 ON i2.stem = pd.s2
  GROUP BY pd.query_id, pd.section_id),
nst AS (SELECT query_id, section_id, count(*) AS n FROM hit_rows GROUP BY query_id, section_id),
win AS (
  SELECT x.query_id, x.section_id, x.pos, y.stem, max(y.pos) AS lastpos
  FROM occ x JOIN occ y ON x.query_id = y.query_id AND x.section_id = y.section_id AND y.pos <= x.pos
  GROUP BY x.query_id, x.section_id, x.pos, y.stem),
win_span AS (
  SELECT query_id, section_id, pos, pos - min(lastpos) AS span, count(*) AS seen
  FROM win GROUP BY query_id, section_id, pos),
sp AS (
  SELECT w.query_id, w.section_id, CAST(min(w.span) AS DOUBLE) AS span, max(n.n) AS n
  FROM win_span w JOIN nst n USING (query_id, section_id)
  WHERE w.seen = n.n GROUP BY w.query_id, w.section_id),
prox AS (
  SELECT hs.*, n.n AS n_lists,
         CASE WHEN n.n < 2 THEN 0.0 ELSE md.min_dist END AS min_dist,
         CASE WHEN n.n < 2 THEN 0.0 ELSE {span_score} END AS min_span,
         CASE WHEN n.n < 2 THEN 0.0 ELSE md.close_idf END AS close_idf
  FROM hit_scores hs JOIN nst n USING (query_id, section_id)
  LEFT JOIN md USING (query_id, section_id) LEFT JOIN sp USING (query_id, section_id))"""


def score_sql(method: str) -> str:
    bm25_prox = (f"({BM25_EXT_K1} + 1) / (2.0 * ((1 - {BM25_EXT_B}) + {BM25_EXT_B} * (num_words / "
                 f"(SELECT avg_sec_len FROM stats)))) * close_idf / 1000.0")
    return {
        "tfidf": "tfidf",
        "tfidf_doclen": "tfidf * CASE WHEN num_words = 0 THEN 0.0 ELSE 1.0 / sqrt(num_words) END",
        "bm25": "bm25",
        "tfidf_ext": "tfidf + (min_dist + min_span) / nj",
        "bm25_ext": f"bm25_ext + {bm25_prox}",
    }[method]


def top_k_sql(source: str, score: str, k: int, extra: str = "") -> str:
    return f"""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, section_id, score{extra} FROM (
  SELECT query_id, section_id, round({score}, 6) AS score{extra},
         row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, section_id DESC) AS rank
  FROM {source}) WHERE rank <= {k}"""


def rank_sql(queries: dict[int, str], method: str, k: int = 10, span_mode: str = "intended",
             length: str = "words", lemma: str = "s_stemmer", df: str = "sum(n_terms)") -> str:
    ctes = (corpus_ctes(length=length, lemma=lemma, df=df) + "," + match_ctes(queries, lemma=lemma) + ","
            + hit_rows_cte())
    source = "hit_scores"
    if method in ("tfidf_ext", "bm25_ext"):
        ctes += "," + proximity_ctes(span_mode)
        source = "prox"
    return "WITH " + ctes + "\n" + top_k_sql(source, score_sql(method), k)


def verb_rule(t: str) -> str:
    return (f"CASE WHEN suffix({t}, 'ing') AND length({t}) > 5 THEN substr({t}, 1, length({t}) - 3) "
            f"WHEN suffix({t}, 'ed') AND length({t}) > 4 THEN substr({t}, 1, length({t}) - 2) ELSE {t} END")


def suffix_tag(t: str) -> str:
    return (f"CASE WHEN suffix({t}, 'ly') THEN 'r' WHEN suffix({t}, 'ing') OR suffix({t}, 'ed') THEN 'v' "
            f"WHEN suffix({t}, 'ous') OR suffix({t}, 'ful') OR suffix({t}, 'ive') OR suffix({t}, 'able') THEN 'j' "
            f"ELSE 'n' END")



def rasolofo_ctes() -> str:
    """All position pairs of two different stems at distance < 6 (needs
    ``occ`` from :func:`proximity_ctes`)."""
    return f"""
pair_all AS (
  SELECT a.query_id, a.section_id, a.stem AS s1, b.stem AS s2,
         sum(1.0 / ((a.pos - b.pos) * (a.pos - b.pos))) AS tpi
  FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.section_id = b.section_id
   AND a.stem < b.stem AND abs(a.pos - b.pos) < 6
  GROUP BY a.query_id, a.section_id, a.stem, b.stem),
ras AS (
  SELECT pa.query_id, pa.section_id, max(h.num_words) AS num_words,
         sum(pa.tpi / (2.0 * ((1 - {BM25_EXT_B}) + {BM25_EXT_B} * (h.num_words / (SELECT avg_sec_len FROM stats)))
             + pa.tpi) * least(i1.bm25idf, i2.bm25idf)) AS ras_sum
  FROM pair_all pa JOIN idf i1 ON i1.stem = pa.s1 JOIN idf i2 ON i2.stem = pa.s2
  JOIN hit_scores h ON h.query_id = pa.query_id AND h.section_id = pa.section_id
  GROUP BY pa.query_id, pa.section_id)"""
