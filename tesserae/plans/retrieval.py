"""Queries over vectors and the inverted index."""

from __future__ import annotations


from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vectors as V
from tesserae.operators import retrieval as R
from tesserae.operators.text_index import TextIndex
from tesserae.sources.tables import scratch, table



def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _vectors(emb):
    """Every stored vector whose id is divisible by 100 asks; an id is both query and entry."""
    return emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def questions(spark, sf_dir):
    """Every benchmark item asks."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vec_l2norm(spark, sf_dir):
    scaled = F.transform(V.to_double(F.col("embedding")), lambda x: x * 3.0)
    unit = V.l2_normalize(scaled)
    return _emb(spark, sf_dir).select("vec_id", F.round(V.norm(unit), 6).alias("norm"), F.round(F.get(unit, 0), 6).alias("first"), F.round(V.norm(scaled), 5).alias("before"))


def vec_cosine(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return R.cosine_scores(emb, _vectors(emb))


def vec_dim_check(spark, sf_dir):
    return R.check_dimension(_emb(spark, sf_dir))


def embedding_valid(spark, sf_dir):
    bad = spark.createDataFrame([(-1, [float("nan")] * 64), (-2, [float("inf")] * 64), (-3, None), (-4, []), (-5, [1.0, None])], "vec_id long, embedding array<double>")
    all_ = _emb(spark, sf_dir).select("vec_id", V.to_double(F.col("embedding")).alias("embedding")).unionByName(bad)
    return R.valid_entries(all_).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))


def knn_topk(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return R.knn(emb, _vectors(emb))


def vec_cross_score(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return R.cross_scores(emb, _vectors(emb))


def score_gate(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return R.score_gate(R.cosine_scores(emb, _vectors(emb), least=0.25), 0.25)


def hit_hydrate(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return R.hydrate(R.knn(emb, _vectors(emb)), docs, "vec_id")


def tok_bm25(spark, sf_dir):
    toks = X.bm25_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(toks).alias("n"), F.array_join(F.slice(toks, 1, 12), " ").alias("head"))


def bm25_tf(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents"))


def bm25_df(spark, sf_dir):
    return R.document_frequency(R.postings(table(spark, sf_dir, "documents")))


def bm25_corpus_stats(spark, sf_dir):
    s = R.corpus_stats(R.document_lengths(table(spark, sf_dir, "documents")))
    return s.withColumn("avg_len", F.round("avg_len", 6))


def bm25_probe(spark, sf_dir):
    """Query terms with their postings and document lengths."""
    return R.probe(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


def bm25_score(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10)


def bm25_index_topk(spark, sf_dir):
    """Every benchmark item asked of a stored index of all documents, put in two goes."""
    docs, index = table(spark, sf_dir, "documents"), TextIndex(spark, scratch(spark, "bm25-index"))
    index.put(docs.filter("doc_id % 2 = 0"))
    index.put(docs.filter("doc_id % 2 = 1"))
    return index.search(questions(spark, sf_dir), R.TOP_K)[0]


def bm25_index_update(spark, sf_dir):
    """The same after a source was taken out, another one's documents were put anew under other texts, and the index was compacted."""
    docs, index = table(spark, sf_dir, "documents"), TextIndex(spark, scratch(spark, "bm25-index"))
    index.put(docs)
    index.remove(docs.filter("source = 'src1'"))
    index.put(docs.filter("source = 'src2'").withColumn("text", F.concat("lang", F.lit(" "), "text")))
    index.compact()
    return index.search(questions(spark, sf_dir), R.TOP_K)[0]


def _pair(spark, sf_dir):
    """Embeddings under document ids, and for each question the vector of its own number."""
    emb = _emb(spark, sf_dir)
    entries = emb.withColumnRenamed("vec_id", "doc_id")
    asked = emb.join(questions(spark, sf_dir), F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return entries, asked, table(spark, sf_dir, "documents"), questions(spark, sf_dir)


def minmax_norm(spark, sf_dir):
    hits = R.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 24)
    return hits.select("query_id", "doc_id", F.round(R.minmax(hits), 6).alias("norm"))


def fuse_full_outer(spark, sf_dir):
    entries, asked, docs, texts = _pair(spark, sf_dir)
    fused = R.fuse(R.knn(entries, asked, 24, id_col="doc_id", gate=-2.0), R.bm25(docs, texts, 24))
    return fused.select("query_id", "doc_id", F.round("dense", 6).alias("dense"), F.round("sparse", 6).alias("sparse"))


def hybrid_topk(spark, sf_dir):
    return R.hybrid(*_pair(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def mmr_select(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    hits = R.knn(emb, _vectors(emb), k=24, gate=-2.0).filter("vec_id <> query_id")
    cands = hits.join(emb.select("vec_id", V.to_double(F.col("embedding")).alias("v")), "vec_id")
    return R.mmr(cands, k=4, lam=0.7)


QUERIES = {
    "vec_l2norm": vec_l2norm,
    "vec_cosine": vec_cosine,
    "vec_dim_check": vec_dim_check,
    "embedding_valid": embedding_valid,
    "knn_topk": knn_topk,
    "vec_cross_score": vec_cross_score,
    "score_gate": score_gate,
    "hit_hydrate": hit_hydrate,
    "tok_bm25": tok_bm25,
    "bm25_tf": bm25_tf,
    "bm25_df": bm25_df,
    "bm25_corpus_stats": bm25_corpus_stats,
    "bm25_probe": bm25_probe,
    "bm25_score": bm25_score,
    "bm25_topk": bm25_topk,
    "bm25_index_topk": bm25_index_topk,
    "bm25_index_update": bm25_index_update,
    "minmax_norm": minmax_norm,
    "fuse_full_outer": fuse_full_outer,
    "hybrid_topk": hybrid_topk,
    "mmr_select": mmr_select,
}

_SCORES = """
    u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(list_transform(u.e, lambda x: x / u.n), q.e), 6) AS score
          FROM u, u q WHERE q.vec_id {which})"""
_WITH = "WITH " + _SCORES
_KNN = """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
_WORDS = "list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1)"
_TOKS = f"""
    tk AS (SELECT doc_id, {_WORDS} AS t FROM documents),
    po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL),
    dl AS (SELECT doc_id, len(t) AS len FROM tk),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark)"""
_RANKED = """,
    st AS (SELECT count(*) AS n, avg(len) AS al FROM dl),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    b AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score
          FROM asked JOIN po USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0)"""
_BM25 = "WITH " + _TOKS + _RANKED
BM25_SQL = _BM25


def _asked_by_items(docs: str) -> str:
    """BM25 of the benchmark's items over the documents that a statement gives."""
    return f"""WITH tk AS (SELECT doc_id, {_WORDS} AS t FROM ({docs})),
    po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL),
    dl AS (SELECT doc_id, len(t) AS len FROM tk),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark){_RANKED} SELECT * FROM r WHERE rank <= 8"""


_NORM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_FUSED = (
    _BM25
    + ","
    + _SCORES.format(which="IN (SELECT item_id FROM benchmark)")
    + _KNN
    + f""",
    d AS (SELECT query_id, vec_id AS doc_id, {_NORM} AS dense FROM k WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id)),
    p AS (SELECT query_id, doc_id, {_NORM} AS sparse FROM r WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, doc_id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse FROM d FULL JOIN p USING (query_id, doc_id))"""
)

ORACLES = {
    "vec_l2norm": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / n, 6) AS first, round(3 * n, 5) AS before FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "vec_cosine": _WITH.format(which="% 100 = 0") + " SELECT * FROM s",
    "vec_dim_check": "SELECT DISTINCT len(embedding) AS dim FROM embeddings",
    "embedding_valid": "SELECT count(*) AS n, min(vec_id) AS least FROM embeddings",
    "knn_topk": _WITH.format(which="% 100 = 0") + _KNN + " SELECT * FROM k WHERE rank <= 8 AND score >= 0",
    "vec_cross_score": _WITH.format(which="% 100 = 0") + " SELECT query_id, count(*) AS n, max(score) AS best, min(score) AS worst FROM s GROUP BY 1",
    "score_gate": _WITH.format(which="% 100 = 0") + " SELECT * FROM s WHERE score >= 0.25",
    "hit_hydrate": _WITH.format(which="% 100 = 0") + _KNN + " SELECT k.*, lang, source FROM k JOIN documents ON doc_id = vec_id WHERE rank <= 8 AND score >= 0",
    "mmr_select": _WITH.format(which="% 100 = 0")
    + _KNN
    + """,
    c AS (SELECT query_id, k.vec_id, score, embedding::DOUBLE[] AS e FROM k JOIN embeddings USING (vec_id) WHERE rank <= 24 AND k.vec_id <> query_id),
    s1 AS (SELECT query_id, vec_id, score, e, 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM c) WHERE n = 1)"""
    + "".join(
        f""",
    v{n} AS (SELECT c.query_id, c.vec_id, c.score, c.e, round(0.7::DOUBLE * c.score - 0.3::DOUBLE * greatest(0, max(list_dot_product(c.e, s.e))), 9) AS v
        FROM c JOIN s{n - 1} s USING (query_id) GROUP BY c.query_id, c.vec_id, c.score, c.e HAVING count(*) FILTER (s.vec_id = c.vec_id) = 0),
    s{n} AS (SELECT * FROM s{n - 1} UNION ALL
        SELECT query_id, vec_id, score, e, {n} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, score DESC, vec_id) AS n FROM v{n}) WHERE n = 1)"""
        for n in (2, 3, 4)
    )
    + " SELECT query_id, vec_id, score, rank FROM s4",
    "tok_bm25": "WITH " + _TOKS + " SELECT doc_id, len(t) AS n, array_to_string(t[1:12], ' ') AS head FROM tk",
    "bm25_tf": "WITH " + _TOKS + " SELECT * FROM po",
    "bm25_df": "WITH " + _TOKS + " SELECT term, count(*) AS df FROM po GROUP BY 1",
    "bm25_corpus_stats": "WITH " + _TOKS + " SELECT count(*) AS n_docs, sum(len) AS total_len, round(avg(len), 6) AS avg_len FROM dl",
    "bm25_probe": "WITH " + _TOKS + " SELECT query_id, term, doc_id, tf, len FROM asked JOIN po USING (term) JOIN dl USING (doc_id)",
    "bm25_score": _BM25 + " SELECT query_id, doc_id, score FROM r",
    "bm25_topk": _BM25 + " SELECT * FROM r WHERE rank <= 10",
    "bm25_index_topk": _asked_by_items("SELECT doc_id, text FROM documents"),
    "bm25_index_update": _asked_by_items("SELECT doc_id, CASE WHEN source = 'src2' THEN lang || ' ' || text ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src1'"),
    "minmax_norm": _BM25 + f" SELECT query_id, doc_id, round({_NORM}, 6) AS norm FROM r WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id)",
    "fuse_full_outer": _FUSED + " SELECT query_id, doc_id, round(dense, 6) AS dense, round(sparse, 6) AS sparse FROM f",
    "hybrid_topk": _FUSED
    + """, h AS (SELECT query_id, doc_id, round(0.5::DOUBLE * dense + 0.5::DOUBLE * sparse, 6) AS score FROM f),
        g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score >= 0)
        SELECT query_id, doc_id, score, rank FROM g JOIN (SELECT vec_id FROM embeddings) ON vec_id = doc_id WHERE rank <= 8""",
}
