import random

import numpy as np
import pytest

from tesserae.llm import minhash
from tesserae.llm.components import components


def brute(rows, percent=85):
    def words_set(t):
        w = [x.lower() for x in (t or "").split()]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [words_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, copies=40):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, n = [], 0
    for _ in range(12):
        base = fresh(rng.randrange(3, 200))
        for _ in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            rows.append((n := n + 1, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
    base = fresh(120)
    for _ in range(copies):
        w = list(base)
        w[rng.randrange(len(w))] = f"y{rng.randrange(9999)}"
        rows.append((n := n + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 8)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rows = corpus(seed) + [(700, "one two"), (701, "One  two"), (702, "two one"), (703, "é x"), (704, "w " * 5000), (705, "w " * 4000), (704, "w " * 5000)]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, cid int, component string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.op6_minhash(spark, "", d).collect())
    assert got == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.op6_minhash(spark, "", d).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (None, 2, None, True), (None, 0, None, True)}
    assert minhash.op6_minhash(spark, "", d.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**63, 1300).astype("u8"))
    a, b = pool[:1000], pool[200:1200]  # similarity 2/3
    s = minhash.sketches([a, b, a[:1], pool[:0]], 4096)
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.03
    assert (s[:3] != np.iinfo("u8").max).all() and (s[3] == np.iinfo("u8").max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100}


def test_overlaps_of_long_sets(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300)).astype("u8")) for _ in range(40)]
    want = [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:20]]
    assert minhash._overlaps(sets[:20], sets[20:]).tolist() == want
    monkeypatch.setattr(minhash, "CELLS", 0)
    assert minhash._overlaps(sets[:20], sets[20:]).tolist() == want


def test_long_texts_and_drifting_chains(spark, monkeypatch):
    """Versions that drift apart, so that buckets link far more than is similar, and texts of a megabyte, compared in blocks by what they hold."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(220)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for at in rng.sample(range(220), rng.choice([1, 3, 6])):  # some steps stay above the threshold, some do not
            words[at] = f"x{rng.randrange(10**6)}"
    long = [f"l{rng.randrange(10**6)}" for _ in range(150_000)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:-900], "new end"])), (102, " ".join(long[:75_000]))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.op6_minhash(spark, "", spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == brute(rows)
