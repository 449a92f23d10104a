"""Connected components of a graph that fits a task, vectorised."""

from __future__ import annotations

import numpy as np


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest vertex of each of ``n`` vertices' component; ``i``, ``j`` are the ends of the edges.

    Roots hook to the smallest root they meet, paths are compressed, edges inside
    a component drop out; every pass at least halves the roots that still have edges.
    """
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            return root
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
