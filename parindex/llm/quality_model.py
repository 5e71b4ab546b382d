"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted on the bytes and words of the whole text (``features``).
Trees are grown level by level on binned statistics of a bounded sample of
labelled rows (``SAMPLE``), with the logistic loss, and flattened into arrays:
all trees are complete binary trees of equal depth, so numpy walks every row
through every tree with one gather per level.

Defined cases: a null text counts as empty (its statistics are zero) and is
scored; rows are scored one by one; rows with a null id or label are not learnt
from; several labels of one document are several examples; without any
labelled row every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import bounded_sample, fold, held_out, table, text_or_empty

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 60, 4, 64, 0.2, 10, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "blank": [32, *range(9, 14)], "symbol": b"#*$%&|<>", "end": b".!?", "comma": b",;:",
    "quote": b"'\"", "bracket": b"()[]{}", "other": b"+-/=@\\^_`~", "high": range(128, 256),
    "control": [*range(0, 9), *range(14, 32), 127],
}
_ONE_HOT = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _ONE_HOT[list(_c), _i] = 1
NAMES = ("log_bytes", "log_words", "word_bytes", *_CLASSES, "distinct_words", "top_word",
         "repeated_pairs", "log_lines", "repeated_lines", "words_per_line", "longest_word", "exclaims")


def features(text: str) -> list[float]:
    """Statistics of one whole text, in the order of ``NAMES``."""
    data = text.encode()
    n = max(len(data), 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (hist @ _ONE_HOT) / n
    words = data.lower().split()
    n_words = max(len(words), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    return [np.log1p(len(data)), np.log1p(len(words)),
            (len(data) - hist[_CLASSES["blank"]].sum()) / n_words, *shares,
            len(counts) / n_words, max(counts.values(), default=0) / n_words,
            1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
            np.log1p(len(lines)), 1 - len(set(lines)) / n_lines, np.log1p(len(words) / n_lines),
            np.log1p(max(map(len, counts), default=0)), hist[33] / n_words]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH,
         rate: float = RATE) -> dict[str, np.ndarray]:
    """Boosted trees as flat arrays: ``feature``/``cut`` (trees, 2^depth - 1), ``leaf`` (trees, 2^depth).

    A row goes right where its statistic is above the cut; a node that is not
    split has an infinite cut, so its rows go left."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    raw = np.full(n, start)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature = np.zeros((trees, inner), np.int32)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)  # node inside the level
        for level in range(depth):
            width = 2 ** level
            gain = np.full((width, m), 0.0)
            where = np.zeros((width, m), np.int64)
            for j in range(m):
                key = at * BINS + bins[:, j]
                hg = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hh = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                hn = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                rg, rh, rn = hg[:, -1:] - hg, hh[:, -1:] - hh, hn[:, -1:] - hn
                score = hg ** 2 / (hh + L2) + rg ** 2 / (rh + L2) - hg[:, -1:] ** 2 / (hh[:, -1:] + L2)
                score[(hn < LEAST) | (rn < LEAST)] = 0
                score[:, len(cuts[j]):] = 0
                where[:, j] = score.argmax(1)
                gain[:, j] = score.max(1)
            best = gain.argmax(1)
            first = width - 1
            for node in range(width):
                j = best[node]
                if gain[node, j] > 1e-9:
                    feature[t, first + node] = j
                    cut[t, first + node] = cuts[j][where[node, j]]
            f, c = feature[t, first + at], cut[t, first + at]
            at = 2 * at + (x[np.arange(n), f] > c)
        sg, sh = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = -rate * sg / (sh + L2)
        raw += leaf[t][at]
    return {"start": np.array(start), "feature": feature, "cut": cut, "leaf": leaf}


def score(model: dict[str, np.ndarray] | None, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: every row through every tree at once, level by level."""
    if model is None:
        return np.full(len(x), 0.5)
    trees, inner = model["feature"].shape
    rows, each = np.arange(len(x))[:, None], np.arange(trees)[None, :]
    node = np.zeros((len(x), trees), np.int64)
    while True:
        first = node[0, 0] if len(x) else inner
        if first >= inner or not len(x):
            break
        go = x[rows, model["feature"][each, node]] > model["cut"][each, node]
        node = 2 * node + 1 + go
    raw = model["start"] + model["leaf"][each, node - inner].sum(1) if len(x) else np.zeros(0)
    return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Model from a bounded sample of labelled documents outside the held-out fold."""
    labels = (labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
              .filter(fold(F.col("doc_id"), 5) != 0))
    chosen = bounded_sample(labels, ["doc_id"], bound)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # the sample has about ``bound`` rows of two numbers, whatever the tables' size
    rows = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"quality": b["quality"].astype("int32"), "x": list(matrix(b["text"].tolist()))})

    data = rows.mapInPandas(measure, "quality int, x array<double>").toPandas()
    if not len(data):
        return None
    data = data.iloc[np.lexsort(np.stack(data["x"].to_list()).T)]  # order of rows must not matter
    return grow(np.stack(data["x"].to_list()), (data["quality"] > 0).to_numpy(float))


def scorer(model):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(model, matrix(texts.fillna("").tolist())))

    return run


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"),
                      scorer(model)(text_or_empty()).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
