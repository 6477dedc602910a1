import hashlib
import math

import numpy as np
import pytest

from siltstone.llm import ballkmeans

NAN, INF = float("nan"), float("inf")


def brute(rows, k, rounds, dim, seed="2"):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    h = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted((h(i), x) for i, x in kept)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        found = [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if r < rounds:
            for j in range(len(centroids)):
                members = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
                if members:
                    centroids[j] = [sum(m[i] for m in members) // len(members) for i in range(dim)]
    inertia = {}
    for d, j in found if kept else ():
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, found if kept else [], strict=True)), key=str)


def run(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<double>, cluster string, distance int")
    return sorted((tuple(r) for r in ballkmeans.cluster(df, k, rounds, dim).collect()), key=str)


@pytest.mark.parametrize("kind", ["clusters", "lattice", "copies"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "lattice":  # whole coordinates: many equal distances
        x = rng.integers(-3, 4, (400, 4)) / 64
    else:
        x = rng.normal(size=(30, 4))[rng.integers(0, 30, 400)] + 0.1 * rng.normal(size=(400, 4))
    if kind == "copies":
        x[::3] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 12, 5, 4) == brute(rows, 12, 5, 4)


def test_odd_rows(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (1, [-5.0, 3.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, -0.0])]
    for k in (1, 3, 40):
        got = run(spark, rows, k, 3, 2)
        assert got == brute(rows, k, 3, 2) and len(got) == 5
    assert run(spark, [], 4, 2, 2) == [] and run(spark, rows[4:8], 4, 2, 2) == []
    with pytest.raises(Exception, match="or more"):
        run(spark, [(1, [1e300, 0.0])], 1, 1, 2)


def test_stable_core_is_compared_with_nothing():
    c = np.array([[0, 0], [100, 0], [0, 300]], np.int64)
    balls = ballkmeans.Balls(c, np.array([60, 10, 10], object))
    assert [list(n) for n in balls.near] == [[1], [], []]  # 300 is beyond twice 60, 100 beyond twice 10
    x = np.array([[49, 0], [50, 0], [51, 0], [99, 0]], np.int64)
    got, d = balls.assign(x, np.array([0, 0, 0, 1]))
    assert got.tolist() == [0, 0, 1, 1] and d.tolist() == [2401, 2500, 2401, 1]  # 50 is a tie: the smaller number
    got, _ = ballkmeans.Balls(c[[1, 0, 2]]).assign(x[1:2], np.array([1]))
    assert got.tolist() == [0]
