import random

import corpus_pipeline
import pytest
from test_decontaminate import brute as brute_overlaps
from test_minhash import brute as brute_groups
from test_suffixes import brute as brute_spans




def corpus():
    rng = random.Random(4)
    syllables = {"en": ["the", "and", "ing", "tion", "er"], "de": ["sch", "ung", "keit", "ein", "ü"]}
    rows, n = [], 0

    def text(lang, words):
        return " ".join("".join(rng.choice(syllables[lang]) + rng.choice("abcdefgh") for _ in range(3)) for _ in range(words))

    passage = text("en", 60)
    items = [(i, text("en", 25)) for i in range(5)]
    for i in range(60):
        lang = rng.choice(["en", "de"])
        t = text(lang, rng.randrange(20, 150))
        if i % 10 == 0:
            t += " " + passage + " " + text(lang, 20)
        if i % 12 == 5:
            t += " " + items[i % 5][1]
        rows.append((n := n + 1, t, lang))
        if i % 7 == 0:
            rows.append((n := n + 1, t, lang))
            words = t.split()
            words[3] = "zzz"
            rows.append((n := n + 1, " ".join(words), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !", "en"), (903, "the", "en"), (1, rows[0][1], "en")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_against_brute_force(spark, folder):
    rows, items = corpus()
    texts = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    stays = {i for i, _, c in brute_groups(texts, percent=80) if c == i}
    unique = {i: t for i, t in texts if i in stays}
    ids = sorted(unique)
    cut = brute_spans([unique[i].encode() for i in ids])
    kept = {}
    for i, (n, gone, _, _) in zip(ids, cut):
        if gone < n:
            kept[i] = gone
    got = corpus_pipeline.run(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r.doc_id: r for r in docs.collect()}
    clean = {r[0] for r in brute_overlaps([(i, r.text) for i, r in left.items()], items) if not r[5]}
    assert set(left) == clean and len(left) == docs.count()
    for i, r in left.items():
        assert len(unique[i].encode()) - len(r.text.encode()) == kept[i] and r.n_chars == len(r.text)
    dirty = {r[0] for r in brute_overlaps([(i, unique[i]) for i in kept], items) if r[5]}
    assert set(kept) - dirty <= set(left)
    assert set(got.doc_id) == set(left)
    for _, g in got.groupby("sequence_id"):
        assert g.length.sum() <= 1024


def test_without_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
