import hashlib
import random

import numpy as np

from tesserae.llm import decontaminate as dc


def brute(docs, items, window=10):
    out = {}
    for n, (doc, text) in enumerate(docs):
        words, hit, found = dc.words_of(text), set(), set()
        for item, t in items:
            w = dc.words_of(t)
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if w else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == w[s : s + size]:
                        hit.update(range(p, p + size))
                        found.add(str(item))
        out[n] = (doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return sorted(out.values(), key=str)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "É", "d1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 7, 9, 10, 14, 30])))) for i in range(12)]
    items += [(3, items[4][1]), (50, items[5][1]), (51, None), (52, "")]
    docs = []
    for d in range(60):
        words = [rng.choice("pqrsabc") for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            words[5:5] = (rng.choice(items)[1] or "").upper().replace("É", "É").split()
        docs.append((d, " ".join(words)))
    return [*docs, (900, None), (901, ""), (0, docs[0][1]), (902, " ".join(i[1] or "" for i in items))], items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = cases(seed)
        d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_words int").repartition(3)
        b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
        got = dc.op10_suffix_decontamination(spark, "", d, b).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items)
        kept = dc.remove_contaminated(d, b)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_blocks_agree(spark, monkeypatch):
    """Several blocks against brute force and against one block, with repeated and null ids."""
    docs, items = cases(9)
    docs += [(None, docs[3][1]), (None, docs[6][1]), (3, docs[6][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    one = dc.op10_suffix_decontamination(spark, "", d, b).collect()
    kept = dc.remove_contaminated(d, b).collect()
    monkeypatch.setattr(dc.overlap_report, "__defaults__", (40,))
    assert dc.count_blocks(b, block_bytes=40) > 3
    got = dc.op10_suffix_decontamination(spark, "", d, b).collect()
    assert sorted(got, key=str) == sorted(one, key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items)
    assert sorted(dc.remove_contaminated(d, b, block_bytes=40).collect(), key=str) == sorted(kept, key=str)


def test_longest_matches():
    tests = dc.Tests.of([("i", [b"a", b"b", b"c", b"d"])], window=2)
    best, where = dc.Shard([[b"x", b"a", b"b", b"c", b"y", b"c", b"d"]], tests).longest()
    assert best.tolist() == [3, 2, 2, 1] and where[:3].tolist() == [1, 2, 5]


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 200).astype("i4")
    order = dc.suffix_array(a, 200)
    assert [tuple(a[i:]) for i in order] == sorted(tuple(a[i:]) for i in range(200))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.op10_suffix_decontamination(spark, "", d, none).first().contaminated is False
    assert dc.op10_suffix_decontamination(spark, "", d.limit(0), none).count() == 0


def test_long_items_and_documents():
    rng = random.Random(3)
    item = [b"%d" % rng.randrange(50) for _ in range(30_000)]
    tests = dc.Tests.of([("i", item), ("j", [b"1"] * 5000)])
    doc = [b"z"] + item[1000:9000] + [b"z"] + [b"1"] * 300
    shard = dc.Shard([doc, [b"1"] * 12], tests)
    best, where = shard.longest()
    assert best[1000] == 8000 and where[1000] == 1
    hit, pairs, bounds = shard.hits()
    assert hit[: len(doc)].sum() == 8300 and {tests.owners[w][0] for d, w in pairs if d == 1} == {"j"}
