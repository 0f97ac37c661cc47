import math

import numpy as np
from test_vectors import brute, frame

from meshloom.llm import vectors


def test_no_link_is_lost_in_few_dimensions(spark, monkeypatch):
    """Vectors of three dimensions within 64, in many small cells, each with a partner at the border of a link."""
    monkeypatch.setattr(vectors, "CELL", 10)
    rng = np.random.default_rng(12)
    basis = np.linalg.qr(rng.standard_normal((64, 3)))[0]
    x, u = (rng.standard_normal((500, 3)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]) @ basis.T)]
    got = sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
