import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import topk, vectors

ODD = [(900, None), (901, [0.0] * 8), (902, [1.0, None, 2.0]), (903, [1.0, math.nan]), (904, [math.inf, 1.0]), (905, [1.0, 0.0]), (906, [])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in ("label", "v", "cell", "home", "mult")})


def padded(rows, dims):
    return np.array([[*v, *[0.0] * (dims - len(v))] for _, v in rows])


def brute(rows, least=0.9):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = padded(ok, max(len(v) for _, v in ok))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in ok])
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    out = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), label, strict=True))
    rest = [(i, 0, i, None if i is None else True) for i, v in rows if (i, v) not in ok]
    return sorted(out + rest, key=repr)


@pytest.mark.parametrize("blocks", [(4, 8), (1024, 4096)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "HOMES", blocks[0])
    monkeypatch.setattr(vectors, "VISITORS", blocks[1])
    monkeypatch.setattr(vectors, "CELL", 25)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    rows = [(1000 + k, (base[k % 40] + rng.standard_normal(8) * rng.choice([0.02, 0.2, 0.35])).tolist()) for k in range(220)]
    rows += [(2000 + k, (base[0] * (1 if k % 2 else 1)).tolist()) for k in range(30)] + ODD + [(5, base[3].tolist()), (5, base[3].tolist()), (None, base[3].tolist())]
    got = sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows), margin=4.0).collect()), key=repr)
    assert got == brute(rows)


def test_recall_at_the_margin(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((1500, 64))
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = vectors.near_vectors(frame(spark, rows)).collect()
    assert sum(r.n_links for r in got) >= 0.99 * 3000 and all(r.n_links <= 1 for r in got)


def test_no_vectors(spark):
    assert vectors.near_vectors(frame(spark, [])).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(frame(spark, [(1, None), (None, [1.0])])).orderBy("vec_id").collect()] == [(None, 0, None, None), (1, 0, 1, True)]


@pytest.mark.parametrize("block", [16, 8192])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "LANE", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(150)] + [(300 + i, [0.5] * 6) for i in range(60)] + ODD + [(None, [1.0] * 6), (7, [0.25] * 6)]
    v = topk.quantized(frame(spark, rows))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect())
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = np.floor(64 * padded(ok, 8)).astype(int)
    want = []
    for k, (i, _) in enumerate(ok):
        if i % 20 == 0:
            s = q @ q[k]
            best = sorted((-int(s[j]), ok[j][0]) for j in range(len(ok)) if ok[j][0] != i)[:20]
            want += [(i, r + 1, c, -m) for r, (m, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v).collect() == [] and topk.top_k(v, v.limit(0)).collect() == []


def test_threshold_search_stops_early():
    rng = np.random.default_rng(2)
    v = np.floor(rng.exponential(size=(20_000, 2)) ** 3 * 64)
    q = np.array([[3.0, 1.0], [1.0, 2.0]])
    best = topk.Best(np.array([-1, -2]), q, 5)
    for part in np.array_split(np.arange(len(v)), 4):
        before = best.scored.copy()
        best.go_through(v[part], part, topk.places(v[part]))
        assert (best.scored - before < len(part) / 4).all()  # the bound, not the end of the lists
    for k in range(2):
        assert best.scores[k].tolist() == np.sort(v @ q[k])[::-1][:5].tolist()


def test_extreme_components_link(spark):
    rows = [(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-200, 2e-200]), (4, [2.0, -1.0]), (5, [5e-324, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame(spark, rows)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
