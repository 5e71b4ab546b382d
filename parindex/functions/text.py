"""Column expressions for text normalisation (tokens table, T1–T15).

All of these run inside the JVM (translate, regexp_extract_all, higher-order
array functions); none ships rows to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values.  They must equal the reference's for equal results.
# --------------------------------------------------------------------------

# Characters replaced by a blank before tokenising (one character each).
CLEAN_CHARS = ",/‘—<>@#:\n\"[]()-“”’'*"

# Python's string.punctuation; a token is dropped when it is a substring of it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Clean-up of the corpus profile (E7): these characters become blanks, then
# the apostrophe as well.
PROFILE_CLEAN_CHARS = "@#:\n-’"

# Tokens that count as sentence ends in the corpus profile.
SENTENCE_END_TOKENS = ["!", ".", "?"]

# English stop-word list of the NLTK corpus (179 words), in its own order.
STOP_WORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't",
    "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
    "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't",
    "won", "won't", "wouldn", "wouldn't",
]

# Token pattern: a word (letters, digits, underscore — Python's Unicode \w),
# a dollar amount, or any other run of non-blank characters.  Written with
# explicit classes so that Java and RE2 (the DuckDB oracle) read it the same.
_WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|\$[\p{Nd}.]+|[^" + _WS + r"]+"

# The same tokens read straight from the raw text: the clean-up characters are
# separators, since no alternative of the pattern can consume them (equal to
# translating them to blanks first, one pass less).  Possessive quantifiers: no
# backtracking.
_CLEAN_CLASS = "".join("\\x{%X}" % ord(c) for c in CLEAN_CHARS)
SEPARATED_TOKEN_PATTERN = (r"[\p{L}\p{N}_]++|\$[\p{Nd}.]++|[^" + _WS + _CLEAN_CLASS + r"]++")

# URL-like and e-mail-like tokens (pipeline 1, T9).  A host is labels joined by
# dots; its last label is any run of two letters or more (no list of endings).
URL_PATTERN = r"^(https?://\S+|www\.\S+|[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)*\.\p{L}{2,}([/?#:]\S*)?)$"
EMAIL_PATTERN = r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[\p{L}]{2,}$"


def stop_words(kind: str | list[str] = "nltk") -> list[str]:
    """Stop-word list: ``"nltk"`` (the reference's), ``"spark"`` (Spark ML's
    default English list, loaded from the JVM) or an explicit list."""
    if isinstance(kind, (list, tuple)):
        return list(kind)
    if kind == "nltk":
        return list(STOP_WORDS_EN)
    if kind == "spark":
        from pyspark.ml.feature import StopWordsRemover
        return list(StopWordsRemover.loadDefaultStopWords("english"))
    if kind == "none":
        return []
    raise ValueError(f"unknown stop-word list {kind!r}")


def clean_text(col: Column, chars: str = CLEAN_CHARS) -> Column:
    """Every listed character becomes a blank."""
    return F.translate(col, chars, " " * len(chars))


def raw_tokens(col: Column, lower: bool = True) -> Column:
    """Lower-case (optional, T10) and split into tokens, as an array."""
    text = F.lower(col) if lower else col
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def is_punctuation(token: Column) -> Column:
    """T4: substring test against ``string.punctuation``."""
    return F.lit(PUNCTUATION).contains(token)


def word_array(section: Column, lower: bool = True) -> Column:
    """Cleaned, tokenised section without punctuation tokens.

    Position ``i`` (0-based) of this array is offset ``i + 1`` (T6); stop words
    keep their slot so that offsets have gaps where they were removed (T5).
    """
    text = F.lower(section) if lower else section
    toks = F.regexp_extract_all(text, F.lit(SEPARATED_TOKEN_PATTERN), 0)
    return F.filter(toks, lambda t: ~is_punctuation(t))


def s_stem(term: Column) -> Column:
    """S-stemmer (Harman 1991) as a column expression; first rule that applies.

    * ``-ies`` (not ``-eies``/``-aies``) -> ``-y``
    * ``-es`` (not ``-aes``/``-ees``/``-oes``) -> ``-e``
    * ``-s`` (not ``-us``/``-ss``) -> drop the ``s``
    Words of one letter are kept as they are.
    """
    n = F.length(term)
    head3 = F.substring(term, F.lit(1), n - 3)
    head1 = F.substring(term, F.lit(1), n - 1)
    ends = term.endswith
    return (
        F.when(ends("ies") & ~ends("eies") & ~ends("aies"), F.concat(head3, F.lit("y")))
        .when(ends("es") & ~ends("aes") & ~ends("ees") & ~ends("oes"), head1)
        .when(ends("s") & ~ends("us") & ~ends("ss") & (n > 1), head1)
        .otherwise(term)
    )


def blank_words(section: Column, clean: bool = True) -> Column:
    """Lower-cased words between blanks, punctuation around them peeled
    off, so that a host name stays one word (``clean`` blanks the clean-up
    characters first, as pipeline 1 does)."""
    text = F.lower(clean_text(section) if clean else section)
    around = "[" + "".join("\\x{%X}" % ord(c) for c in PUNCTUATION) + "]+"
    words = F.transform(F.split(text, f"[{_WS}]+"), lambda w: F.regexp_replace(w, f"^{around}|{around}$", ""))
    return F.filter(words, lambda w: w != "")


def is_url_like(token: Column) -> Column:
    return token.rlike(URL_PATTERN)


def is_email_like(token: Column) -> Column:
    return token.rlike(EMAIL_PATTERN)
