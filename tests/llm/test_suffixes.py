import hashlib
import random

import pytest

from tesserae.llm import suffixes as sx


def brute(texts):
    """Per text: (bytes, removed, spans, digest of the rest)."""
    seen = {}
    for d, b in enumerate(texts):
        for p in range(len(b) - sx.WIDTH + 1):
            seen.setdefault(b[p : p + sx.WIDTH], []).append((d, p))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + sx.WIDTH] = b"\1" * sx.WIDTH
    out = []
    for b, g in zip(texts, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (not i or not g[i - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [fresh(n) for n in (180, 199, 230, 300, 700)]
    out = []
    for _ in range(30):
        parts = [fresh(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(60)
            parts += [s[a : len(s) - rng.randrange(60)], fresh(rng.randrange(80))]
        out.append("".join(parts))
    out += [None, "", "x" * 150, "x" * 199, "x" * 500, "ab" * 300, "abcdefg " * 90, "short", out[3], out[3], fresh(5000)]
    out += [out[-1][1000:3000], fresh(400) + out[-1][4100:4500]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:  # as on large tables: several merging tasks, joins instead of broadcasts
        monkeypatch.setattr(sx, "MERGED", 60)
        monkeypatch.setattr(sx, "BROADCAST_BYTES", -1)
    texts = corpus(seed)
    rows = [(i // 2 if i > 40 else i, t, b"k", 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(*r[:2], bytearray(r[2]), r[3]) for r in rows], "doc_id long, text string, key binary, places int").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.op5_suffix_array(spark, "", d).collect())
    want = sorted((r[0], *x) for r, x in zip(rows, brute([(t or "").encode() for t in texts])))
    assert got == want


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(sx, "SEGMENT", 700)
    rng = random.Random(5)
    b = bytes(rng.choice(b"abcdef") for _ in range(5000))
    doc, seed, packed = sx.anchors([b, b""])
    owned = set()
    for p in packed.tolist():
        at, before, more = p >> 16, p >> 8 & 255, p & 255
        owned.update(range(at - before, at - before + more + 1))
        assert 0 <= before < sx._REACH and before - more >= 0
    assert owned == set(range(len(b) - sx.WIDTH + 1))


def test_merge_and_front_coding():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20)))
            shared, rests = sx.front_code(s)
            import numpy as np

            assert sx.front_decode(shared, np.array([len(x) for x in s], "u2"), rests) == s
            runs.append((shared.tolist(), s))
        got, before = [], b""
        for r, i, n in sx.merge_runs(runs):
            s = runs[r][1][i]
            assert n == sx.common_prefix(before, s, 0) or not got
            got.append(s)
            before = s
        assert got == sorted(s for r in runs for s in r[1])


def test_removal_keeps_columns(spark):
    same = "repeated passage of some length " * 10
    rng = random.Random(8)
    own = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(2)]
    d = spark.createDataFrame([(1, same + own[0], "x", 9), (2, same + own[1], "y", 9), (3, same, "z", 9), (4, None, None, None), (5, "é", "q", 1)], "doc_id long, text string, _key string, n_chars long")
    got = {r.doc_id: r for r in sx.remove_repeats(d, count_col="n_chars").collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text.endswith(own[0][50:]) and got[1].n_chars == len(got[1].text) and got[5].text == "é"
    assert sx.op5_suffix_array(spark, "", d.limit(0)).count() == 0


@pytest.mark.parametrize("merged", [8, 20, 100_000])
def test_hot_seed_in_ranges(spark, monkeypatch, merged):
    """Two headers below, around and above WIDTH in most texts: their seeds' contexts are cut into ranges, and nothing changes."""
    monkeypatch.setattr(sx, "MERGED", merged)
    cut = []
    found = sx._splitters
    monkeypatch.setattr(sx, "_splitters", lambda runs: cut.append(found(runs)) or cut[-1])
    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abc \n") for _ in range(n))
    short, long = fresh(120), fresh(260)
    tails, heads = [fresh(n) for n in (60, 79, 80, 90, 170)], [fresh(n) for n in (60, 79, 80, 90, 170)]
    texts = []
    for i in range(160):
        texts.append(rng.choice([fresh(90), fresh(30) + rng.choice(heads)]) + (short if i % 3 else long) + rng.choice([fresh(200), rng.choice(tails) + fresh(50)]))
    texts += [short + fresh(300), long, long, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.op5_suffix_array(spark, "", d).collect())
    assert got == sorted(brute([(t or "").encode() for t in texts]))
    assert bool(cut[0]) == (merged < 100_000)
