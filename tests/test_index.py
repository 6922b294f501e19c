"""The stored index against scoring everything, and tables of snapshots."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vectors as V
from tesserae.operators import retrieval as R
from tesserae.operators.rag import overlap_scores
from tesserae.operators.text_index import TextIndex
from tesserae.sources.snapshots import Conflict, SnapshotTable

DOCS, ASKED = "doc_id long, text string, slice int, seq string", "query_id long, query string"


def texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]  # a few words are in nearly every text
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)


QUESTIONS = [(1, "w0 w1 w150"), (2, "w3 w90 w200 w201"), (3, "w0"), (4, "nothing known"), (5, "w7 w7 w7, w12"), (6, ""), (7, None)]


def plain(spark, rows, k=5, **how):
    return {tuple(r) for r in R.bm25(frame(spark, rows), spark.createDataFrame(QUESTIONS, ASKED), k, **how).collect()}


def found(index, spark, k=5, **how):
    hits, pruning = index.search(spark.createDataFrame(QUESTIONS, ASKED), k, **how)
    return {tuple(r) for r in hits.collect()}, pruning


def test_search_skips_blocks_and_equals_full_scoring(spark, tmp_path):
    rows = texts(900)
    index = TextIndex(spark, f"file://{tmp_path}/a", slice_docs=16)
    index.put(frame(spark, rows))
    got, pruning = found(index, spark)
    assert got == plain(spark, rows) and pruning.skipped > 20
    assert found(index, spark, k1=0.3, b=0.1)[0] == plain(spark, rows, k1=0.3, b=0.1)
    assert found(index, spark, k=2000)[0] == plain(spark, rows, 2000)


def test_put_remove_put_equals_a_rebuild(spark, tmp_path):
    rows = texts(200)
    index = TextIndex(spark, f"file://{tmp_path}/b", slice_docs=8)
    assert found(index, spark) == (set(), found(index, spark)[1])
    index.put(frame(spark, rows[:120]))
    first = index.manifests.load()[0]
    index.remove(frame(spark, rows[:40] + [(10**6, "")]))
    newer = [(i, f"{t} w150 w150") for i, t in rows[100:130]]  # some of them anew, some for the first time
    index.put(frame(spark, newer + newer[:3]))
    index.put(frame(spark, rows[20:30]))  # removed ones come back
    index.put(frame(spark, [(None, "w0"), (5000, None)]))
    left = rows[40:100] + newer + rows[20:30]
    assert found(index, spark)[0] == plain(spark, left)
    assert index.stats() == tuple(R.corpus_stats(R.document_lengths(frame(spark, left))).select("n_docs", "total_len").first())
    df = {tuple(r) for r in R.document_frequency(R.postings(frame(spark, left))).collect()}
    assert {tuple(r) for r in index.document_frequency().collect()} == df
    assert found(index, spark, version=first)[0] == plain(spark, rows[:120])
    before = index.manifests.load()[0]
    assert index.remove(frame(spark, [(10**7, "")])) == before
    index.compact()
    assert found(index, spark)[0] == plain(spark, left) and len(index.manifests.load()[1]["segments"]) == 1
    assert {tuple(r) for r in index.document_frequency().collect()} == df
    index.remove(frame(spark, left))
    assert found(index, spark)[0] == set() and index.stats() == (0, 0) and index.document_frequency().count() == 0


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, v double")


def held(table, version=None):
    df = table.read(version)
    return set() if df is None else {tuple(r) for r in df.collect()}


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "id")
    assert t.read() is None and t.delete("source", "a") == (0, 0)
    one = t.put(entries(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (None, "b", 0.0)]))
    two = t.put(entries(spark, [(2, "c", 9.0), (4, "a", 4.0)]))
    assert held(t) == {(1, "a", 1.0), (2, "c", 9.0), (3, "b", 3.0), (4, "a", 4.0), (None, "b", 0.0)}
    three, n = t.delete("source", "a")
    assert n == 2 and held(t) == {(2, "c", 9.0), (3, "b", 3.0), (None, "b", 0.0)}
    assert t.delete("source", "a") == (three, 0)
    t.put(entries(spark, [(1, "a", 7.0)]))  # a buried key comes back
    assert held(t) == {(1, "a", 7.0), (2, "c", 9.0), (3, "b", 3.0), (None, "b", 0.0)}
    assert held(t, one) == {(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (None, "b", 0.0)} and len(held(t, two)) == 5
    now = held(t)
    t.compact()
    assert held(t) == now and t.sweep() > 3 and held(t) == now and t.manifests.versions() == [5]
    last = t.put(spark.createDataFrame([(8, "x", 1.0, 2), (8, "y", 2.0, 1)], "id long, source string, v double, at int").select("id", "source", "v", "at"), seq="at")
    assert t.read(last).filter("id = 8").select("source").first()[0] == "x"


def test_failed_commits_leave_the_table_as_it_was(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "id")
    t.put(entries(spark, [(1, "a", 1.0)]))
    base, manifest = t.manifests.load()
    t._stage(entries(spark, [(1, "lost", 0.0), (2, "lost", 0.0)]))  # a writer that died before its commit
    assert held(t) == {(1, "a", 1.0)}
    broken = entries(spark, [(5, "z", 1.0)]).withColumn("v", F.raise_error(F.lit("lost task")).cast("double"))
    with pytest.raises(Exception, match="lost task"):
        t.put(broken)
    assert held(t) == {(1, "a", 1.0)} and t.manifests.versions() == [1]
    other = SnapshotTable(spark, f"file://{tmp_path}/t", "id")
    other.put(entries(spark, [(3, "b", 3.0)]))
    with pytest.raises(Conflict):  # this one read version 1 and comes second
        t._add(base, manifest, entries(spark, [(4, "c", 4.0)]), "rows")
    assert held(t) == {(1, "a", 1.0), (3, "b", 3.0)}


def test_rerank_takes_rare_tokens_first(spark):
    """The same documents as by comparing every item with every document, ties and repeated tokens included."""
    from tesserae.functions import text as X
    from tesserae.operators import rag as G

    rows = texts(400, 3) + [(1000, None), (1001, ""), (1002, "w0 w0 w1"), (1003, "w0 w0 w1")]
    rng = random.Random(6)
    asked = [(i, " ".join(rng.choices([f"w{k}" for k in range(200)] + ["unknown"], [1 / (k + 1) for k in range(200)] + [0.2], k=rng.randrange(1, 30)))) for i in range(60)] + [(90, ""), (91, None), (92, "w299 w298 w297")]
    docs, items = frame(spark, rows), spark.createDataFrame(asked, "item long, hyp string")
    got = {tuple(r) for r in G.rerank_corpus(docs, items, "item", "doc_id", "text", "hyp").collect()}
    share = {}
    for r in docs.crossJoin(items).select("item", "doc_id", F.round(X.token_overlap(F.col("hyp"), F.col("text")), 6).alias("s")).filter("s > 0").collect():
        share.setdefault(r.item, []).append((-r.s, r.doc_id))
    assert got == {(i, d, -s, n) for i, found in share.items() for n, (s, d) in enumerate(sorted(found)[:4], 1)}
    assert G.rerank_corpus(docs.limit(0), items, "item", "doc_id", "text", "hyp").count() == 0


def test_cached_vectors(spark, tmp_path):
    """A model that writes down what it is asked: every text once, over several runs, and nothing of failed ones."""
    from tesserae.functions.embed import hashed_vectors
    from tesserae.operators.vector_cache import VectorCache

    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        if "broken" in texts:
            raise ValueError("no answer")
        return hashed_vectors(texts)

    rows = [(i, f"text {i % 40}") for i in range(100)] + [(200, None), (201, "")]
    cache = VectorCache(spark, f"file://{tmp_path}/c", "m", model, batch=7)
    assert cache.fill(frame(spark, rows[:50])) == 40 and asked.value == 40
    got = {r.doc_id: r.embedding for r in cache.embed(frame(spark, rows)).collect()}
    assert asked.value == 41 and got == {i: hashed_vectors([t or ""])[0] for i, t in rows}
    version = cache.manifests.load()[0]
    assert cache.fill(frame(spark, rows)) == 0 and asked.value == 41 and cache.manifests.load()[0] == version
    with pytest.raises(Exception, match="no answer"):
        cache.fill(frame(spark, [(1, "broken")]))
    assert cache.entries().count() == 41 and cache.fill(frame(spark, rows).limit(0)) == 0
    other = VectorCache(spark, f"file://{tmp_path}/c", "m2", model)
    assert other.fill(frame(spark, rows[:10])) == 10  # another model has its own entries
    real = cache.manifests.load
    stale = [real()]  # another run commits in between: this one adds its entries to the new version
    cache.fill(frame(spark, [(1, "between")]))
    cache.manifests.load = lambda v=None: stale.pop() if stale else real(v)
    assert cache.fill(frame(spark, [(1, "late")])) == 1
    assert cache.missing(frame(spark, [(1, "between"), (2, "late"), (3, "text 3"), (4, "unseen")])).select("text").collect() == [("unseen",)]


def test_queries_in_blocks(spark, monkeypatch):
    """More bytes of queries than one pass broadcasts: the same scores."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    whole = sorted(map(tuple, R.knn(rows, asked, 3).collect()))
    monkeypatch.setattr(R, "QUERY_BYTES", 256)
    assert sorted(map(tuple, R.knn(rows, asked, 3).collect())) == whole and len(whole) > 15
    assert R.knn(rows, asked.limit(0), 3).count() == 0


def test_block_scores_equal_the_expressions(spark, monkeypatch):
    """Blocks against a join of rows: copies, zero and null vectors, null and odd entries, other lengths, scores that end in a 5."""
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    vecs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vecs += [vecs[0], vecs[1], vecs[0], [0.0] * 4, None, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 2.0], [], [1e200] * 4]
    asked = [(0, vecs[0]), (1, [0.0000005, 0.0, 0.0, 0.0]), (2, [0.5, None, 0.0, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [1e9, -1e9, 3.0, 0.1]), (6, [float("nan")] * 4), (7, [])]
    e = spark.createDataFrame([(i, v) for i, v in enumerate([[2.0, 0.0, 0.0, 0.0], *vecs])], "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, q array<double>")
    slow = e.crossJoin(q).select("query_id", "vec_id", F.round(V.dot(V.l2_normalize(F.col("embedding")), F.col("q")), 6).alias("score"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(R.cosine_scores(e, q)) == rows(slow)
    assert rows(R.cosine_scores(e, q, least=0.25)) == rows(slow.filter("score >= 0.25"))
    for k in (3, 24):
        assert rows(R.nearest(e, q, k)) == rows(R._ranked(slow, ["query_id"], "vec_id", k))
    want = slow.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))
    assert rows(R.cross_scores(e, q)) == rows(want)


def test_words_of_no_query_are_not_shuffled(spark):
    """Terms meet documents by broadcast whatever Spark estimates, and frequencies and scores of a document stay in one task; copies of an id count as before."""
    docs, asked = frame(spark, [*texts(50), (3, "w1 w2 w1")]), spark.createDataFrame(QUESTIONS, ASKED)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.bm25(docs, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan) and "hashpartitioning(doc_id" in plan
        overlap = overlap_scores(docs, asked, "query_id", "doc_id", "text", "query")
        assert "SortMergeJoin" not in overlap._jdf.queryExecution().executedPlan().toString()
        terms = asked.select("query_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("query")))).alias("term"))
        slow = R.postings(docs).join(terms, "term").join(R.document_lengths(docs), "doc_id").select("query_id", "term", "doc_id", "tf", "len")
        assert sorted(map(tuple, R.probe(docs, asked).collect())) == sorted(map(tuple, slow.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_index_keeps_postings_once_and_search_moves_no_scores(spark, tmp_path):
    """A segment has blocks and frequencies alone, and scores of a slice leave it for the ranking only. Ties, tombstones, repeated questions, and slices that compaction joins."""
    rows = texts(60, 8) + [(i, "w1 w2 w150") for i in range(100, 140)]  # more equal scores than k
    asked = spark.createDataFrame([(i, f"w{i % 7} w{i % 290} w150") for i in range(300)] + [(3, "w9 w150"), (None, "w1")], ASKED)
    index = TextIndex(spark, f"file://{tmp_path}/c", slice_docs=8)
    index.put(frame(spark, rows[:50]))
    index.put(frame(spark, rows[50:]))
    index.remove(frame(spark, rows[:45:2]))
    left = sorted({*rows} - {*rows[:45:2]})

    def slices():
        found = index._read(index.manifests.load()[1], "blocks", ("rows",)).filter("term IS NULL")
        return [r[0] for r in found.select(F.size("postings")).collect()]

    terms = asked.filter("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("query")))).alias("term"))
    posted, n = R.postings(frame(spark, left)), len(left)
    stats, lengths = R.corpus_stats(R.document_lengths(frame(spark, left))), R.document_lengths(frame(spark, left))
    part = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    slow = terms.join(posted, "term").join(R.document_frequency(posted), "term").join(lengths, "doc_id").crossJoin(stats).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    want = {tuple(r) for r in R._ranked(slow.filter("score > 0"), ["query_id"], "doc_id", 5).select("query_id", "doc_id", "score", "rank").collect()}
    hits = index.search(asked, 5)[0]
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", hits._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in hits.collect()} == want
    assert all({p.name for p in d.iterdir()} <= {"blocks", "df", "dead"} for d in (tmp_path / "c" / "data").iterdir())
    before = slices()
    index.compact()
    assert sum(slices()) == n and len(slices()) < len(before)
    assert {tuple(r) for r in index.search(asked, 5)[0].collect()} == want
