"""The chance to meet of every plan of the lattice tables."""

import numpy as np
import pytest

from tidemark.llm import lattice


@pytest.mark.parametrize("groups,tables", [p[1:] for p in lattice.PLANS])
def test_every_plan_meets_at_the_threshold(groups, tables):
    rng = np.random.default_rng(groups)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 4000, 64)))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    assert np.allclose((a * b).sum(axis=1), 0.9)
    chosen = lattice.Tables(64, groups, tables)
    x, y = chosen.cells(a), chosen.cells(b)
    met = (x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.975
