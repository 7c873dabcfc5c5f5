"""Posteriors against enumeration where the transitions can't be inverted."""

import itertools

import numpy as np
import pytest

from quillmark.llm import language


def enumerated(emit, trans, begin):
    n, k = emit.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        score = begin[path[0]] + sum(emit[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        for t, y in enumerate(path):
            total[t, y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("trans", [np.zeros((3, 3)), np.ones((3, 3)) * 2.5, np.array([[1.0, 0, -1], [1, 0, -1], [0, 2, 0]]), np.random.default_rng(0).normal(size=(3, 3))])
@pytest.mark.parametrize("segment", [2, 100])
def test_start_scores_count_with_any_transitions(trans, segment, monkeypatch):
    monkeypatch.setattr(language, "_SEGMENT", segment)
    rng, begin = np.random.default_rng(1), np.array([2.0, 0.0, -2.0])
    sizes = np.array([1, 5, 2, 7, 3])
    emit = rng.normal(size=(sizes.sum(), 3))
    got, _, _ = language.posteriors(emit, sizes, trans, begin)
    at = 0
    for n in sizes:
        assert np.abs(got[at : at + n] - enumerated(emit[at : at + n], trans, begin)).max() < 1e-12
        at += n
