"""Toxicity by a linear-chain conditional random field over tokens.

Token labels come from the labelled documents: words and word beginnings that
are more frequent in toxic than in other training documents (``RATIO``), by more than chance explains (a
likelihood-ratio test over the distinct texts of all labelled documents), tag their tokens in toxic documents; every other training
token is clean.  The field has two tags; its
features are the token's entry in the lexicon (its word, or else its
longest listed beginning), entries beside it and the tag transitions.  Forward-backward marginals of every
token of the whole text add up to the document's score, and the tokens whose
marginal passes ``TAG`` are its offending offsets.

Defined cases: a null text counts as empty and is scored (no tokens); rows are
scored one by one; rows with a null id or label are not learnt from; without
toxic training rows every score is the share of toxic rows (0 without rows); an
empty table has no rows; columns other than id, text and label are not read;
texts of any length are tagged whole; a text with both labels counts for both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from parindex.llm.common import cut, fold, held_out, table, text_or_empty, written

SAMPLE = 8_000         # labelled documents the field and the calibration learn from, half of them toxic
PREFIXES = (3, 4, 5, 6)  # bytes
RATIO = 4.0            # least smoothed ratio of an entry's shares in toxic and in other documents
ENTRIES = 400_000      # entries counted in a task before they are handed on
TRAIN_WINDOW, TRAIN_WINDOWS, STEPS = 48, 4_000, 80
TAG = 0.5
_LANE = 64

#: bytes that belong to no token become blanks; letters A-Z are lower-cased
_KEEP = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


def entries(word: bytes) -> list[bytes]:
    """What the lexicon can list of a token: its word, then its beginnings (marked by ``*``), longest first."""
    return [word, *[word[:k] + b"*" for k in reversed(PREFIXES) if len(word) > k]]


class _Ids(dict):
    """token -> number of its lexicon entry (0: none); remembers a bounded number of tokens."""

    def __init__(self, lexicon: list[bytes], limit: int = 200_000):
        super().__init__()
        self.known, self.limit = {w: i + 1 for i, w in enumerate(lexicon)}, limit

    def __missing__(self, word: bytes) -> int:
        found = next((self.known[x] for x in entries(word) if x in self.known), 0)
        if len(self) < self.limit:
            self[word] = found
        return found


def word_ids(text: str, lexicon: _Ids) -> np.ndarray:
    found = tokens(text)
    return np.fromiter(map(lexicon.__getitem__, found), np.int32, len(found))


def emissions(ids: np.ndarray, first: np.ndarray, p: dict) -> np.ndarray:
    """Score of tag 1 over tag 0 per token: its word, the words beside it.

    ``first`` marks the first token of every text; texts do not see each other."""
    e = p["word"][ids]
    side = p["side"][(ids > 0).astype(int)]
    before, after = np.zeros_like(e), np.zeros_like(e)
    before[1:], after[:-1] = side[:-1], side[1:]
    before[first] = 0
    after[:-1][first[1:]] = 0
    return e + before + after


def marginals(e: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(tag 1) of every token by forward-backward; ``size`` tokens per text.

    Exact for any length: texts are cut into lanes of ``_LANE`` tokens whose
    2x2 products are chained per text, then every lane runs side by side."""
    n = len(e)
    if not n:
        return np.zeros(0)
    a = np.exp(trans)
    n_lane = -(-size // _LANE)
    text_of = np.repeat(np.arange(len(size)), n_lane)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_lane) - n_lane, n_lane)
    begin = (np.cumsum(size) - size)[text_of] + nth * _LANE
    length = np.minimum(size[text_of] - nth * _LANE, _LANE)
    lanes = len(text_of)
    w = np.ones((_LANE, lanes))  # weight of tag 1 over tag 0
    pos = np.arange(_LANE)[:, None]
    live = pos < length
    w[live] = np.exp(np.clip(e, -30, 30))[(begin + pos)[live]]
    start = nth == 0

    def step(x0, x1, t):
        """Row vectors (x0, x1) through token t of each lane; texts start evenly."""
        s = x0 + x1
        y0, y1 = x0 * a[0, 0] + x1 * a[1, 0], x0 * a[0, 1] + x1 * a[1, 1]
        if t == 0:
            y0, y1 = np.where(start, s, y0), np.where(start, s, y1)
        y1 = y1 * w[t]
        z = y0 + y1
        y0, y1 = y0 / z, y1 / z
        ok = live[t]
        return np.where(ok, y0, x0), np.where(ok, y1, x1), np.where(ok, z, 1.0)

    # product of each lane as what becomes of the two unit rows (with their scale)
    rows, scale = [], []
    for unit in ((1.0, 0.0), (0.0, 1.0)):
        x0, x1, log = np.full(lanes, unit[0]), np.full(lanes, unit[1]), np.zeros(lanes)
        for t in range(_LANE):
            x0, x1, z = step(x0, x1, t)
            log += np.log(z)
        rows.append((x0, x1))
        scale.append(log)
    top = np.maximum(*scale)
    m = [[np.exp(scale[r] - top) * rows[r][c] for c in (0, 1)] for r in (0, 1)]
    # chain the lanes of a text; texts with many lanes first, so a prefix is active
    order = np.argsort(-n_lane, kind="stable")
    first_lane = (np.cumsum(n_lane) - n_lane)[order]
    many = n_lane[order]
    into = np.full((2, lanes), 0.5)
    out_of = np.full((2, lanes), 0.5)
    most = int(many.max())
    for k in range(most - 1):
        act = first_lane[:np.searchsorted(-many, -(k + 1), side="left")] + k
        v0, v1 = into[0, act], into[1, act]
        y0, y1 = v0 * m[0][0][act] + v1 * m[1][0][act], v0 * m[0][1][act] + v1 * m[1][1][act]
        into[0, act + 1], into[1, act + 1] = y0 / (y0 + y1), y1 / (y0 + y1)
    for k in range(most - 1, 0, -1):
        act = first_lane[:np.searchsorted(-many, -k, side="left")] + k
        v0, v1 = out_of[0, act], out_of[1, act]
        y0, y1 = m[0][0][act] * v0 + m[0][1][act] * v1, m[1][0][act] * v0 + m[1][1][act] * v1
        out_of[0, act - 1], out_of[1, act - 1] = y0 / (y0 + y1), y1 / (y0 + y1)
    alpha = np.empty((_LANE, 2, lanes))
    x0, x1 = into
    for t in range(_LANE):
        x0, x1, _ = step(x0, x1, t)
        alpha[t, 0], alpha[t, 1] = x0, x1
    b0, b1 = out_of
    prob = np.empty((_LANE, lanes))
    for t in range(_LANE - 1, -1, -1):
        g1, g0 = alpha[t, 1] * b1, alpha[t, 0] * b0
        prob[t] = g1 / (g0 + g1)
        ok = live[t]
        c0, c1 = a[0, 0] * b0 + a[0, 1] * w[t] * b1, a[1, 0] * b0 + a[1, 1] * w[t] * b1
        z = c0 + c1
        b0, b1 = np.where(ok, c0 / z, b0), np.where(ok, c1 / z, b1)
    flat = np.empty(n)
    flat[(begin + pos)[live]] = prob[live]
    return flat


def _pairs(e: np.ndarray, size: np.ndarray, trans: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected transition counts (2, 2) over short texts, by plain forward-backward; texts count by ``weight``."""
    total = np.zeros((2, 2))
    a = np.exp(trans)
    begin = np.cumsum(size) - size
    for n in np.unique(size):
        at, counts = begin[size == n], weight[size == n, None, None]
        if n < 2 or not len(at):
            continue
        w = np.stack([np.ones((len(at), n)), np.exp(np.clip(e, -30, 30))[at[:, None] + np.arange(n)]], 2)
        f = [w[:, 0] / w[:, 0].sum(1, keepdims=True)]
        for t in range(1, n):
            x = (f[-1] @ a) * w[:, t]
            f.append(x / x.sum(1, keepdims=True))
        b = np.ones((len(at), 2))
        for t in range(n - 1, 0, -1):
            wb = w[:, t] * b
            joint = f[t - 1][:, :, None] * a[None] * wb[:, None, :]
            total += (counts * joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = wb @ a.T
            b /= b.sum(1, keepdims=True)
    return total


def train(windows: list[tuple[np.ndarray, np.ndarray, float]], odds: np.ndarray, steps: int = STEPS) -> dict:
    """Maximum likelihood with an L2 prior; ``windows``: (word ids, tags, weight) of short token runs.

    ``odds``: log-odds of the entries in whole documents, the mean of their prior, so that an
    entry too rare for the windows keeps them."""
    n_words = len(odds)
    p = {"word": np.array([-3.0, *odds]), "side": np.zeros(2), "trans": np.zeros((2, 2))}
    mean = {"word": np.array([0.0, *odds]), "side": 0.0, "trans": 0.0}
    windows = [w for w in windows if len(w[0])]
    if not windows:
        return p
    ids = np.concatenate([i for i, _, _ in windows])
    tags = np.concatenate([y for _, y, _ in windows]).astype(float)
    size = np.array([len(i) for i, _, _ in windows])
    weight = np.array([w for _, _, w in windows])
    each = np.repeat(weight, size)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(size) - size] = True
    real = np.zeros((2, 2))
    joined = ~first[1:]
    np.add.at(real, (tags[:-1][joined].astype(int), tags[1:][joined].astype(int)), each[1:][joined])
    near = (ids > 0).astype(int)
    speed = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        e = emissions(ids, first, p)
        miss = each * (tags - marginals(e, size, p["trans"]))
        grad = {"word": np.bincount(ids, miss, n_words + 1), "side": np.zeros(2),
                "trans": real - _pairs(e, size, p["trans"], weight)}
        np.add.at(grad["side"], near[:-1][joined], miss[1:][joined])
        np.add.at(grad["side"], near[1:][joined], miss[:-1][joined])
        for k, g in grad.items():
            g = g - 0.05 * (p[k] - mean[k])
            speed[k] += g * g
            p[k] = p[k] + 0.7 * g / (np.sqrt(speed[k]) + 1e-6)
    return p


class Tagger:
    """Marginals and document statistics of a batch of whole texts."""

    def __init__(self, model: dict):
        self.model = model
        self.lexicon = _Ids(model["lexicon"])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per text, marginals of all tokens, statistics (n, 2) per text)."""
        ids = [word_ids(t, self.lexicon) for t in texts]
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = np.zeros(len(flat), bool)
        begin = np.cumsum(size) - size
        first[begin[size > 0]] = True
        prob = marginals(emissions(flat, first, self.model["field"]), size, self.model["field"]["trans"])
        stats = np.zeros((len(texts), 2))
        full = np.flatnonzero(size > 0)
        if len(full):
            stats[full, 0] = np.maximum.reduceat(prob, begin[full])
            sure = np.where(prob > 0.05, prob, 0)  # the long tail of near-zero marginals is no evidence
            stats[full, 1] = np.log1p(np.add.reduceat(sure, begin[full]))
        return size, prob, stats

    def scores(self, stats: np.ndarray) -> np.ndarray:
        c = self.model["calibration"]
        return 1 / (1 + np.exp(-np.clip(stats @ c[:2] + c[2], -40, 40)))


def spans(text: str, chosen: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the chosen tokens; neighbours join into one span."""
    data = text.encode().translate(_KEEP)
    out: list[tuple[int, int]] = []
    at, last = 0, -2
    chars = len(data) == len(text)
    want = set(chosen.tolist())
    for k, word in enumerate(data.split()):
        at = data.index(word, at)
        if k in want:
            if last == k - 1:
                out[-1] = (out[-1][0], at + len(word))
            else:
                out.append((at, at + len(word)))
            last = k
        at += len(word)
    if chars:
        return out
    raw = text.encode()
    return [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in out]


def _calibrate(stats: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the document statistics (Newton steps); rows count by ``weight``."""
    x = np.column_stack([stats, np.ones(len(stats))])
    c = np.zeros(3)
    prior = np.diag([0.01, 0.01, 0.001])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + prior
        move = np.linalg.solve(h, x.T @ (weight * (y - q)) - prior @ c)
        c += np.clip(move, -2, 2)
    return c


def evidence(tox: np.ndarray, rest: np.ndarray, n_tox: int, n_rest: int) -> np.ndarray:
    """Likelihood ratio (G squared) of entries in ``tox`` toxic and ``rest`` other documents against the
    share of toxic documents; 0 where they are no more frequent in toxic documents."""
    n, base = tox + rest, n_tox / (n_tox + n_rest)
    share = tox / np.maximum(n, 1)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    g = 2 * (tox * (log(share) - log(base)) + rest * (log(1 - share) - log(1 - base)))
    return np.where(share > base, g, 0.0)


def choose(found: dict[bytes, tuple[int, int]], n_tox: int, n_rest: int, bar: float) -> dict[bytes, float]:
    """Entry -> log-odds of the entries that pass ``bar`` and ``RATIO``; ``found``: toxic and other counts."""
    if not found:
        return {}
    tox, rest = np.array(list(found.values()), float).T
    ratio = (tox + 0.5) / (n_tox + 1) / ((rest + 0.5) / (n_rest + 1))
    passed = (evidence(tox, rest, n_tox, n_rest) >= bar) & (ratio >= RATIO)
    share = dict(zip(found, np.where(passed, (tox + 0.5) / (tox + rest + 1), 0)))
    # a beginning stands for all that begins so, unless that is toxic clearly more often
    kept = [w for w, q in share.items() if q and not any(
        share.get(x, 0) >= 0.8 * q for x in entries(w.rstrip(b"*")) if len(x.rstrip(b"*")) < len(w.rstrip(b"*")))]
    return {w: float(np.log(share[w] / (1 - share[w]))) for w in sorted(kept)}


@F.pandas_udf(BinaryType())
def _packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    press = zstandard.ZstdCompressor(level=3)
    for texts in batches:
        yield texts.map(lambda t: press.compress(t.encode()))


def _texts(batch: pd.DataFrame) -> list[str]:
    """The whole texts of a batch with packed ones."""
    press = zstandard.ZstdDecompressor()
    return [press.decompress(z).decode() for z in batch["z"]]


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Lexicon from all labelled documents outside the held-out fold; field and calibration from a
    sample of them, bounded per class."""
    labels = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .filter(fold(F.col("doc_id"), 4) != 2)
              .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")))
    learnt = docs.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", text_or_empty().alias("text"))
    hashes = {"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    # copies of a text with one label count once; ids and hashes meet the labels, then each distinct text
    # crosses one exchange, compressed, and meets the marked hashes where it lies
    marked = (learnt.select("doc_id", *[c.alias(n) for n, c in hashes.items()]).distinct()
              .join(labels.distinct(), "doc_id").groupBy("h", "h2", "toxic").agg(F.min("doc_id").alias("doc_id")))
    packed = learnt.select(*[c.alias(n) for n, c in hashes.items()], _packed("text").alias("z"))
    rows = written(packed.groupBy("h", "h2").agg(F.first("z").alias("z")).join(marked, ["h", "h2"])
                   .select("doc_id", "h", "z", "toxic"))
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_tox, n_rest = totals.get(1, 0), totals.get(0, 0)
    empty = {"lexicon": [], "field": train([], np.zeros(0))}
    base = np.clip(n_tox / (n_tox + n_rest), 1e-6, 1 - 1e-6) if n_tox + n_rest else 1e-6
    if not n_tox:
        return empty | {"calibration": np.array([0.0, 0.0, np.log(base / (1 - base))])}

    def counted(batches):
        tox, n = Counter(), Counter()
        for b in batches:
            for t, y in zip(_texts(b), b["toxic"]):
                found = {x for word in set(tokens(t)) for x in entries(word)}
                n.update(found)
                if y:
                    tox.update(found)
                if len(n) > ENTRIES:
                    yield pd.DataFrame({"w": list(n), "tox": [tox[w] for w in n], "n": list(n.values())})
                    tox, n = Counter(), Counter()
        yield pd.DataFrame({"w": list(n), "tox": [tox[w] for w in n], "n": list(n.values())})

    words = written(rows.select("z", "toxic").mapInPandas(counted, "w binary, tox long, n long").groupBy("w")
                    .agg(F.sum("tox").alias("tox"), F.sum("n").alias("n")).filter("tox > 0"))
    # among all entries tested, about one passes the bar by chance
    bar = 2 * float(np.log(max(words.count(), 2)))
    base = n_tox / (n_tox + n_rest)
    share, rest = F.col("tox") / F.col("n"), F.col("n") - F.col("tox")
    log_rest = F.when(rest > 0, rest * F.log((1 - share) / max(1 - base, 1e-300))).otherwise(0.0)
    gain = 2 * (F.col("tox") * F.log(share / base) + log_rest)
    ratio = ((F.col("tox") + 0.5) / (n_tox + 1)) / ((rest + 0.5) / (n_rest + 1))
    known = {bytes(r["w"]): (r["tox"], r["n"] - r["tox"]) for r in words.withColumn("g", gain)
             .filter((share > base) & (F.col("g") >= bar - 1e-6) & (ratio >= RATIO - 1e-6))
             .collect()}

    def contexts(batches):
        for b in batches:
            found = set()
            for t, y in zip(_texts(b), b["toxic"]):
                words = [b"", *tokens(t), b""] if y else []
                for k in range(1, len(words) - 1):
                    for x in entries(words[k]):
                        if x in known:
                            found.add((x, words[k - 1] + b" " + words[k + 1]))
            yield pd.DataFrame({"w": [w for w, _ in found], "c": [c for _, c in found]})

    # copies repeat a word in one and the same context; what marks toxic texts comes in many
    spread = {bytes(r[0]): r[1] for r in rows.filter("toxic = 1").mapInPandas(contexts, "w binary, c binary")
              .distinct().groupBy("w").count().collect()}
    known = {w: (min(n, spread[w]), rest) for w, (n, rest) in known.items()}
    odds = choose(known, n_tox, n_rest, bar)
    lexicon = list(odds)
    ids = _Ids(lexicon)
    shares = {1: min(1.0, bound / 2 / n_tox), 0: min(1.0, bound / 2 / max(n_rest, 1))}
    hashed = F.pmod(F.xxhash64(F.lit(17), "doc_id", "h"), F.lit(1 << 30)) / float(1 << 30)
    sample = cut(rows.filter(hashed < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])))
    weights = {y: min(shares.values()) / s for y, s in shares.items()}
    n_sample = {y: max(1.0, n * shares[y]) for y, n in ((1, n_tox), (0, n_rest))}
    share = min(1.0, TRAIN_WINDOWS / sum(n_sample.values()))

    def windows(batches):
        for b in batches:
            keep = []
            for doc_id, text, y in zip(b["doc_id"], _texts(b), b["toxic"]):
                i = word_ids(text, ids)
                hits = np.flatnonzero(i)
                # toxic documents around a lexicon word, the others anywhere, both a bounded share
                rng = np.random.default_rng(abs(int(doc_id)))
                if rng.random() < (share if not len(hits) else min(1.0, TRAIN_WINDOWS / 2 / n_sample[1])):
                    at = int(hits[rng.integers(len(hits))]) if len(hits) else int(rng.integers(len(i) + 1))
                    lo = max(0, at - int(rng.integers(TRAIN_WINDOW)))
                    keep.append((doc_id, i[lo:lo + TRAIN_WINDOW], int(y)))
            yield pd.DataFrame({"doc_id": [k[0] for k in keep], "i": [k[1] for k in keep],
                                "y": [k[2] for k in keep]}).astype({"doc_id": "int64", "y": "int32"})

    got = sorted((r[0], tuple(r[1]), r[2]) for r in sample.mapInPandas(
        windows, "doc_id long, i array<int>, y int").collect())
    runs = [(np.array(i, np.int64), (np.array(i) > 0) * y, weights[y]) for _, i, y in got]
    model = {"lexicon": lexicon, "field": train(runs, np.array(list(odds.values()))), "calibration": np.zeros(3)}

    def measure(batches):
        tagger = Tagger(model)
        for b in batches:
            stats = tagger.batch(_texts(b))[2]
            yield pd.DataFrame({"a": stats[:, 0], "b": stats[:, 1], "y": b["toxic"]})

    found = sample.mapInPandas(measure, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    return model | {"calibration": _calibrate(found[["a", "b"]].to_numpy(), found["y"].to_numpy(float),
                                              found["y"].map(weights).to_numpy(float))}


def scorer(model: dict):
    """Pandas UDF text -> struct<score, n_toxic_tokens, offending>."""

    @F.pandas_udf("score double, n_toxic_tokens long, offending string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            texts = texts.fillna("").tolist()
            size, prob, stats = tagger.batch(texts)
            begin = np.cumsum(size) - size
            tagged = np.flatnonzero(prob >= TAG)
            owner = np.searchsorted(begin + size, tagged, side="right")
            n = np.bincount(owner, minlength=len(texts))
            where = [""] * len(texts)
            last = np.cumsum(n)
            for k in np.flatnonzero(n):
                own = tagged[last[k] - n[k]:last[k]] - begin[k]
                where[k] = ",".join(f"{a}:{b}" for a, b in spans(texts[k], own))
            yield pd.DataFrame({"score": tagger.scores(stats), "n_toxic_tokens": n.astype("int64"),
                                "offending": where})

    return run


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"),
                      scorer(model)(text_or_empty()).alias("r"))
    return out.select("doc_id", "held_out", "r.score",
                      F.when(F.col("r.score") >= 0.3, 1).otherwise(0).alias("predicted"),
                      "r.n_toxic_tokens", "r.offending")
