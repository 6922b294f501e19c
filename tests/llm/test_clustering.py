import hashlib
import math

import numpy as np
import pytest

from tesserae.llm import clustering as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, q int, distance string"


def slow(rows, k=16, rounds=3):
    """Plain integers, every distance, every round; results in the order of the kept rows."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= C.LARGEST for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [q for _, q in sorted(kept, key=key)[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    total = sum(f[2] for f in found)
    inertia = [sum(f[2] for f in found if f[1] == j) for j in range(len(cents))]
    return [(*f, inertia[f[1]], total, hashlib.sha256(",".join(map(str, cents[f[1]])).encode()).hexdigest()) for f in found]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def vectors(n, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, 64)) * spread
    return [(i, (middles[i % 7] + rng.normal(size=64) * 0.4).tolist()) for i in range(n)]


def check(spark, rows):
    got = [tuple(r) for r in C.op11_centroid_clusters(spark, "", frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(slow(rows), key=repr)
    return got


def test_matches_plain_rounds(spark):
    rows = vectors(300)
    # many equal rows at the same place, equal ids, no id, coarse vectors that tie, and what is left out
    rows += [(1000 + i, [0.25] * 64) for i in range(150)] + [(5, [0.5] * 64), (5, [-0.5] * 64), (None, [1.0] * 64), (None, [0.0] * 64)]
    rows += [(2000 + i, [float(i % 3 == j % 3) for j in range(64)]) for i in range(60)]
    out = [(3000, None), (3001, []), (3002, [0.0] * 63), (3003, [0.0] * 63 + [None]), (3004, [0.0] * 63 + [float("nan")]), (3005, [float("inf")] * 64), (3006, [1e30] * 64)]
    got = check(spark, rows + out)
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16])
def test_few_vectors(spark, n):
    assert len(check(spark, vectors(n, 3))) == n


def test_large_components(spark):
    edge = float(C.LARGEST)
    got = check(spark, [(i, [edge if (i >> (j % 4)) & 1 else -edge for j in range(64)]) for i in range(40)] + [(99, [edge + 1] * 64)])
    assert len(got) == 40


def test_bounds_spare_scans_and_never_err():
    rng = np.random.default_rng(5)
    middles = rng.integers(-60, 60, (6, 64))
    q = (middles[rng.integers(0, 6, 4000)] + rng.integers(-9, 10, (4000, 64))).astype(np.int64)
    c = q[[0, 1, 2, 3, 3, 5]]  # two centroids in one place
    own, upper, lower = C.nearest(q, c)
    spared = 0
    for _ in range(6):
        new = np.array([q[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
        drift = C._up(np.sqrt(((new - c) ** 2).sum(1).astype(float)))
        c = new
        own, upper, lower, scans = C.reassign(q, own, upper, lower, c, drift)
        spared += len(q) - scans
        d = C.squared(q, c)
        assert (own == d.argmin(1)).all()
        rest = d.astype(float)
        rest[np.arange(len(q)), own] = np.inf
        assert (upper >= np.sqrt(d[np.arange(len(q)), own])).all() and (lower <= np.sqrt(rest.min(1))).all()
    assert spared > 4000
