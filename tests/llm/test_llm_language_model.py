"""Sums of the training rounds of op10 against plain ones."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from haulmark.llm import language_model as model  # noqa: E402


@pytest.mark.parametrize("n", [1, 15, 16, 17, 1000, 8192])
@pytest.mark.parametrize("distinct", [1, 3, 500, model.FEATURES])
def test_rows_are_added_up(n, distinct):
    rng = np.random.default_rng(n + distinct)
    rows = rng.integers(0, distinct, n).astype(np.int32) * (model.FEATURES // distinct)
    values = rng.random((n, model.CLASSES), dtype=np.float32)
    got = np.ones((model.FEATURES, model.CLASSES), np.float32)
    want = np.ones((model.FEATURES, model.CLASSES))
    model.add_rows(got, rows, values)
    np.add.at(want, rows, values)
    assert np.allclose(got, want, rtol=1e-5)


@pytest.mark.parametrize("classes", [1, 5, 64])
def test_probabilities_of_large_scores(classes):
    rng = np.random.default_rng(classes)
    weights = rng.normal(0, 60, (50, classes)).astype(np.float32)
    bias, rows = rng.normal(0, 1, classes).astype(np.float32), rng.integers(0, 50, (4, 200))
    z = weights[rows].astype(np.float64).sum(axis=0) + bias
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(model.softmax(weights, bias, rows), want, atol=1e-4)
    assert np.allclose(np.exp(model.log_softmax(weights, bias, rows)), want, atol=1e-4)
