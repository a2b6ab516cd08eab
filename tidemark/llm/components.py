"""Connected components: the library's distributed search, and the parts of one task."""

from __future__ import annotations

import numpy as np

from tidemark.operators.components import components

__all__ = ["components", "forest"]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that join what the pairs join."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]
