import math

import numpy as np
import pytest

from siltstone.llm import crosspolytope as cp

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold):
    """id -> (links, smallest id reachable), ids distinct."""
    fine = {i: (np.array(v, float) / max(map(abs, v)), label) for i, v, label in rows if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    by = {}
    for i, (v, label) in fine.items():
        by.setdefault((label, len(v)), []).append((i, v / np.linalg.norm(v)))
    for group in by.values():
        ids, x = [i for i, _ in group], np.stack([v for _, v in group])
        for a, row in zip(ids, x @ x.T >= threshold, strict=True):
            links[a] |= {ids[j] for j in np.flatnonzero(row)} - {a}
    low = {}
    for i in sorted(links):
        front = [i] if i not in low else []
        while front:
            a = front.pop()
            if a not in low:
                low[a] = i
                front += links[a]
    return {i: (len(n), low[i]) for i, n in links.items()}


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "id long, v array<double>, label int, t string, cnt double")
    return {r.id: (r.n_links, r.component_id) for r in cp.near_duplicates(df.repartition(6), **more).collect()}


def at(rng, x, cosine):
    """Vectors at the given cosines to rows of x."""
    z = rng.normal(size=x.shape)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * u).sum(1, keepdims=True) * u
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.asarray(cosine)[:, None]
    return (c * u + np.sqrt(1 - c * c) * z) * rng.uniform(0.1, 9, (len(x), 1))


def test_pairs_around_the_threshold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 64))
    y = at(rng, x, rng.uniform(0.925, 0.945, len(x)))
    rows = [(int(i), v.tolist(), int(i) % 3) for i, v in enumerate(np.concatenate([x, y]))]
    rows = [(i, v, label if i < 1200 else (i - 1200) % 3) for i, v, label in rows]
    want = brute(rows, 0.93)
    assert 600 < sum(n for n, _ in want.values()) < 2200
    assert run(spark, rows) == want


@pytest.mark.parametrize("spread,block", [(0.995, 4096), (0.995, 40), (0.97, 60), (0.955, 50), (0.955, 4096)])
def test_a_group_of_a_third(spark, spread, block):
    """Copies of one vector at a cosine of `spread` to it, and vectors around the threshold to it; in small blocks too."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 48))
    x[:300] = at(rng, np.repeat(x[:1], 300, 0), np.full(300, spread))
    x[300:420] = at(rng, np.repeat(x[:1], 120, 0), rng.uniform(0.9, 0.96, 120))
    x[420:430] = x[:10]
    rows = [(int(i) + 7, v.tolist(), 1 if i < 600 else 2) for i, v in enumerate(x)]
    assert run(spark, rows, block=block) == brute(rows, 0.93)


def test_chains_are_one_component(spark):
    turn = [[math.cos(a), math.sin(a)] for a in np.arange(40) * 0.3]  # neighbours at 0.955, next ones at 0.825
    rows = [(100 - i, v, 1) for i, v in enumerate(turn[:11])] + [(200 + i, v, 2) for i, v in enumerate(turn[:3])]
    assert run(spark, rows, block=3) == brute(rows, 0.93)


@pytest.mark.parametrize("dim", [1, 2, 3, 20, 200])
def test_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim))
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in enumerate(np.concatenate([x, at(rng, x, np.full(150, 0.95)) if dim > 1 else -x]))]
    rows = [(i, v, (i % 150) % 2) for i, v, _ in rows]
    assert run(spark, rows) == brute(rows, 0.93)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 3.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [NAN, 1.0], 1), (6, [INF, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (9, [], 1)]
    rows += [(10, [1.0, 0.0], None), (11, [1.0, 0.0], None), (12, [1.0, 0.0], 2), (13, [-1.0, 0.0], 1), (14, [1e-300, 1e-302], 1), (15, [1e300, 1e299], 1), (16, [-0.0, 2.0], 1)]
    assert run(spark, rows) == brute(rows, 0.93)
    assert run(spark, []) == {}
    df = spark.createDataFrame([(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [-3.0, 1.0], 1), (7, [2.0, 4.0], 1)], "id long, v array<double>, label int")
    got = sorted((tuple(r) for r in cp.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (None, 0, None), (7, 3, 5)], key=str)


def test_rotations_keep_angles():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 8))
    y = cp.hadamard(x) / math.sqrt(8)
    assert np.allclose(y @ y.T, x @ x.T)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, more = cp.axes(u, 4)
    assert near.shape == (20, cp.PROBES) and (np.diff(more, axis=1) >= 0).all() and (more[:, 0] == 0).all()


def test_tables_follow_size_and_chance():
    assert [cp.n_hashes(n, 64) for n in (10, 1_000, 100_000, 10_000_000)] == [1, 2, 3, 4]
    assert cp.n_tables(64, 2, 0.93) < cp.n_tables(64, 3, 0.93) < 20
