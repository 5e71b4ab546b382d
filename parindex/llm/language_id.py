"""Language identification by a bidirectional gated recurrent network over bytes.

Two small GRUs (one per direction) read windows of a text's UTF-8 bytes, one
softmax layer labels every position, and the mean of the position
probabilities is the document's distribution.  The network is trained in numpy
by backpropagation through time on a bounded sample of labelled segments
(``PER_LANG`` documents per language, ``SEGMENTS`` segments of ``SEGMENT``
characters each); every position of every whole text is scored.

The gates use softsign, x / (1 + |x|), where the textbook has tanh and the
logistic function: it costs an eighth of them in numpy.

Defined cases: a null text or one without a letter is ``und`` with score 0;
rows are scored one by one (repeated rows repeat); a null language or id is not
learnt from; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parindex.llm.common import fold, held_out, table, text_or_empty

PER_LANG, SEGMENTS, SEGMENT = 400, 6, 120
HIDDEN, WINDOW, LANES = 8, 128, 1024
STEPS, BATCH, TRAIN_WINDOW = 300, 160, 64


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(s: np.ndarray) -> np.ndarray:
    """Derivative of softsign where its value is ``s``."""
    return (1 - np.abs(s)) ** 2


def init(n_langs: int, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters: per direction byte table (3H, 256), recurrent (3H, H), and the output layer."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.5, (3 * hidden, 256))
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p[f"o{d}"] = rng.normal(0, 0.5, (n_langs, hidden))
    p["bias"] = np.zeros((n_langs, 1))
    return p


def _run(x: np.ndarray, u: np.ndarray, order: range, keep: list | None, codes: np.ndarray) -> np.ndarray:
    """States (T, H, B) of one direction; ``keep`` gets what the backward pass needs."""
    hidden = u.shape[1]
    steps, lanes = codes.shape
    states = np.zeros((steps, hidden, lanes))
    h = np.zeros((hidden, lanes))
    for t in order:
        g = x[:, codes[t]]
        a = u @ h
        zr = 0.5 * _soft(g[:2 * hidden] + a[:2 * hidden]) + 0.5
        z, r = zr[:hidden], zr[hidden:]
        n = _soft(g[2 * hidden:] + r * a[2 * hidden:])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((t, h, z, r, n, a[2 * hidden:]))
        states[t] = h = new
    return states


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, langs: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions and its gradient (BPTT, both directions).

    ``codes`` (T, B) bytes; ``langs`` (B,) the language of each lane."""
    steps, lanes = codes.shape
    hidden = p["uf"].shape[1]
    saved: dict[str, list] = {"f": [], "b": []}
    states = {"f": _run(p["xf"], p["uf"], range(steps), saved["f"], codes),
              "b": _run(p["xb"], p["ub"], range(steps - 1, -1, -1), saved["b"], codes)}
    logits = np.einsum("lh,thb->tlb", p["of"], states["f"]) + np.einsum(
        "lh,thb->tlb", p["ob"], states["b"]) + p["bias"]
    logits -= logits.max(1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(1, keepdims=True)
    loss = -np.log(np.maximum(prob[:, langs, np.arange(lanes)], 1e-30)).mean()
    delta = prob
    delta[:, langs, np.arange(lanes)] -= 1
    delta /= steps * lanes
    grad = {"bias": delta.sum((0, 2))[:, None]}
    for d in "fb":
        grad[f"o{d}"] = np.einsum("tlb,thb->lh", delta, states[d])
        dx, du = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
        u, carry = p[f"u{d}"], np.zeros((hidden, lanes))
        for t, h, z, r, n, an in reversed(saved[d]):
            dh = carry + p[f"o{d}"].T @ delta[t]
            dn = dh * (1 - z) * _slope(n)
            dz = dh * (h - n) * 0.5 * _slope(2 * z - 1)
            dr = dn * an * 0.5 * _slope(2 * r - 1)
            dg = np.concatenate([dz, dr, dn])
            da = np.concatenate([dz, dr, dn * r])
            du += da @ h.T
            np.add.at(dx.T, codes[t], dg.T)
            carry = dh * z + u.T @ da
        grad[f"x{d}"], grad[f"u{d}"] = dx, du
    return loss, grad


def lanes_of(step: int, n_langs: int) -> np.ndarray:
    """Language of each lane in a step (from 1): lanes go on where the last step stopped."""
    return ((step - 1) * BATCH + np.arange(BATCH)) % n_langs


def steps_for(n_langs: int, steps: int = STEPS) -> int:
    """Least number of steps from ``steps`` on in which every language has as many windows; up to
    ``BATCH`` languages share ``steps``, more get a number of steps that grows with them."""
    least = -(-steps * max(n_langs, BATCH) // BATCH)
    whole = n_langs // np.gcd(n_langs, BATCH)
    return int(-(-least // whole) * whole)


def train(texts: list[str], langs: list[str], steps: int = STEPS, hidden: int = HIDDEN,
          seed: int = 5) -> dict:
    """Adam over random windows, each language equally often; at least ``steps`` steps."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    by_lang = [[b for t, x in zip(texts, langs) if x == name and (b := t.encode())] for name in names]
    names = [n for n, b in zip(names, by_lang) if b]
    by_lang = [b for b in by_lang if b]
    if not names:
        return {"langs": []}
    p = init(len(names), hidden, seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    steps = steps_for(len(names), steps)
    for step in range(1, steps + 1):
        lanes = lanes_of(step, len(names))
        codes = np.zeros((TRAIN_WINDOW, BATCH), np.uint8)
        for lane, lang in enumerate(lanes):
            b = by_lang[lang][rng.integers(len(by_lang[lang]))]
            at = rng.integers(max(1, len(b) - TRAIN_WINDOW + 1))
            piece = np.frombuffer(b[at:at + TRAIN_WINDOW], np.uint8)
            codes[:, lane] = np.resize(piece, TRAIN_WINDOW)  # a short segment is repeated
        _, grad = gradients(p, codes, lanes)
        rate = 0.03 * min(1.0, 1.5 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return {"langs": names} | {k: v.astype(np.float32) for k, v in p.items()}


class Scorer:
    """Inference with lanes of windows side by side; buffers are reused."""

    def __init__(self, model: dict):
        self.langs, self.m = model["langs"], {}
        for d in "fb" if self.langs else "":
            self.m[d] = (model[f"x{d}"], model[f"u{d}"], model[f"o{d}"])
        self.bias = model.get("bias")
        self.room: dict[int, tuple[np.ndarray, ...]] = {}

    def _step(self, d: str, codes: np.ndarray, h: np.ndarray) -> None:
        x, u, _ = self.m[d]
        k, lanes = h.shape
        if lanes not in self.room:
            self.room[lanes] = tuple(np.empty((3 * k, lanes), np.float32) for _ in range(3))
        g, a, b = self.room[lanes]
        np.take(x, codes, axis=1, out=g, mode="clip")
        np.matmul(u, h, out=a)
        zr, n, an, size = g[:2 * k], g[2 * k:], a[2 * k:], b[:2 * k]
        zr += a[:2 * k]
        np.abs(zr, out=size)
        size += 1
        zr /= size
        zr *= 0.5
        zr += 0.5
        an *= zr[k:]
        n += an
        size = b[2 * k:]
        np.abs(n, out=size)
        size += 1
        n /= size
        h -= n
        h *= zr[:k]
        h += n

    def windows(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes, mask (T, B) -> per lane the sum of probabilities and the label counts (L, B)."""
        steps, lanes = codes.shape
        hidden = self.m["f"][1].shape[1]
        h = np.zeros((hidden, lanes), np.float32)
        part = np.empty((steps, len(self.langs), lanes), np.float32)
        for t in range(steps):
            self._step("f", codes[t], h)
            np.matmul(self.m["f"][2], h, out=part[t])
        total = np.zeros((len(self.langs), lanes), np.float32)
        count = np.zeros((len(self.langs), lanes), np.float32)
        h[:] = 0
        whole = mask.all()
        for t in range(steps - 1, -1, -1):
            self._step("b", codes[t], h)
            if not whole:
                h *= mask[t]
            y = part[t]
            y += self.m["b"][2] @ h
            y += self.bias
            np.clip(y, -60, 60, out=y)
            top = y.max(0)
            hit = y == top
            np.exp(y, out=y)
            weight = y.sum(0)
            np.reciprocal(weight, out=weight)
            if not whole:
                weight *= mask[t]
                hit &= mask[t] > 0
            y *= weight
            total += y
            count += hit
        return total, count

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean position probabilities and the label counts (n, L)."""
        data = [t.encode() for t in texts]
        size = np.array([len(b) for b in data], np.int64)
        flat = np.frombuffer(b"".join(data) or b"\0", np.uint8)
        begin = np.cumsum(size) - size
        n_win = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(data)), n_win)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        at, left = begin[doc] + nth * WINDOW, size[doc] - nth * WINDOW
        order = np.argsort(-np.minimum(left, WINDOW), kind="stable")  # whole windows first
        total = np.zeros((len(data), len(self.langs)))
        count = np.zeros((len(data), len(self.langs)))
        for k in range(0, len(order), LANES):
            lane = order[k:k + LANES]
            steps = int(min(WINDOW, left[lane].max()))
            pos = np.arange(steps)[:, None]
            mask = (pos < left[lane]).astype(np.float32)
            codes = flat[np.minimum(at[lane] + pos, len(flat) - 1)]
            s, c = self.windows(codes, mask)
            for lang in range(len(self.langs)):
                total[:, lang] += np.bincount(doc[lane], s[lang], len(data))
                count[:, lang] += np.bincount(doc[lane], c[lang], len(data))
        return total / np.maximum(size, 1)[:, None], count


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """Segments of about ``per_lang`` documents per language, chosen by a hash of the id.

    ``docs``: doc_id, text, lang.  Only counts per language and the bounded
    segments come to the driver."""
    docs = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items()
                           for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    # bounded for each language, so the total grows with the number of languages
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
                         < F.element_at(share, F.col("lang")) * float(1 << 30))
    piece = lambda k: F.substring("text", (1 + F.pmod(
        F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.length("text") - SEGMENT, F.lit(1)))).cast("int"),
        F.lit(SEGMENT))
    rows = chosen.select("doc_id", "lang", *[piece(k).alias(f"s{k}") for k in range(SEGMENTS)])
    rows = sorted(tuple(r) for r in rows.collect())
    return ([s for r in rows for s in r[2:]], [r[1] for r in rows for _ in r[2:]])


def predictor(model: dict):
    """Pandas UDF text -> struct<lang_pred, score, n_positions, n_positions_pred>."""

    @F.pandas_udf("lang_pred string, score double, n_positions long, n_positions_pred long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            texts = texts.fillna("").tolist()
            n = len(texts)
            if not scorer.langs:
                yield pd.DataFrame({"lang_pred": ["und"] * n, "score": [0.0] * n,
                                    "n_positions": [0] * n, "n_positions_pred": [0] * n})
                continue
            prob, count = scorer.documents(texts)
            best = prob.argmax(1)
            row = np.arange(n)
            yield pd.DataFrame({
                "lang_pred": np.array(scorer.langs, object)[best], "score": np.clip(prob[row, best], 0, 1),
                "n_positions": count.sum(1).astype("int64"),
                "n_positions_pred": count[row, best].astype("int64")})

    return predict


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> dict:
    """Model learnt from text and lang of the rows where ``learn`` holds."""
    return train(*training_sample(docs.filter(learn).select("doc_id", "text", "lang"), per_lang))


def identify(docs: DataFrame, model: dict, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """``docs`` with a struct column ``out``; texts without a letter are not scored."""
    text = text_or_empty(text_col)
    letters = text.rlike(r"\p{L}")
    scored = predictor(model)(F.when(letters, text).otherwise(""))
    docs = docs.withColumn(out, scored)
    return docs.withColumn(out, F.when(letters, F.col(out)).otherwise(F.struct(
        F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_positions"),
        F.lit(0).cast("long").alias("n_positions_pred"))))


def learnable(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 4) != 2


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_id.*")
