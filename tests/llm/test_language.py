"""Training lanes of op2 with more languages than lanes."""

from collections import Counter

import numpy as np
import pytest

from parindex.llm import language_id


@pytest.mark.parametrize("n", [1, 4, 7, 160, 161, 176, 400])
def test_every_language_is_trained_equally_often(monkeypatch, n):
    seen = Counter()

    def gradients(p, codes, langs):
        seen.update(langs.tolist())
        return 0.0, {k: np.zeros_like(v) for k, v in p.items()}

    monkeypatch.setattr(language_id, "gradients", gradients)
    model = language_id.train(["some text"] * n, [f"l{k:03}" for k in range(n)])
    assert len(model["langs"]) == n and sorted(seen) == list(range(n)) and len(set(seen.values())) == 1
    assert min(seen.values()) * n >= language_id.STEPS * language_id.BATCH


def test_least_score_follows_the_number_of_languages():
    from corpus_pipeline import least_language_score
    assert least_language_score(1) == least_language_score(2) == least_language_score(4) == 0.4
    assert abs(least_language_score(200) - 0.008) < 1e-12
