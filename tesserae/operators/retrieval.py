"""Retrieval: dense top-k, BM25 over an inverted index, hybrid fusion, gating, MMR, and the index as tables.

Vectors and postings are tables; a set of queries is scored against all rows. Queries are broadcast in
blocks of a stated size, never the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vectors as V

# Defaults of the search.
K1, B = 1.5, 0.75
TOP_K, ALPHA, GATE, MMR_LAMBDA = 8, 0.5, 0.0, 0.5
#: Bytes of query vectors that one pass over the corpus broadcasts.
QUERY_BYTES = 32 << 20
#: Rows of a table of query terms or hits that is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Vectors of a block.
BLOCK_ROWS = 1024
DIGITS = 6  # scores are rounded so that equal scores tie alike on every engine


def _ranked(scored: DataFrame, by: list[str], id_col: str, k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def valid_entries(entries: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Entries whose vector is a non-empty array of finite numbers."""
    return entries.filter(V.is_valid(V.to_double(F.col(vec_col))))


def check_dimension(entries: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: the dimension; raises when the result is evaluated if there are several."""
    found = entries.agg(F.min(F.size(vec_col)).alias("dim"), F.max(F.size(vec_col)).alias("most"))
    checked = F.when(F.col("dim") == F.col("most"), F.col("dim")).otherwise(F.raise_error(F.lit("vectors of different dimensions")))
    return found.select(F.when(F.col("dim").isNotNull(), checked).alias("dim"))


def _packed(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Rows of an id and a vector of doubles in blocks of one length: ids, whether each vector has a null entry, entries end to end; length -1: null vectors."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = [prefix + n for n in ("ids", "length", "nulls", "body")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                ids, vecs = (c.slice(lo, BLOCK_ROWS) for c in batch.columns)
                lengths = vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for n in np.unique(lengths).tolist():
                    at = pa.array(np.flatnonzero(lengths == n))
                    flat = vecs.take(at).flatten()
                    nulls = np.asarray(flat.is_null()).reshape(len(at), max(n, 0)).any(1)
                    body = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
                    own = ids.take(at)
                    own = pa.ListArray.from_arrays([0, len(own)], own)
                    yield pa.RecordBatch.from_arrays([own, pa.array([n], pa.int32()), pa.array([nulls.tobytes()], pa.binary()), pa.array([body.tobytes()], pa.binary())], names)

    return rows.mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} int, {names[2]} binary, {names[3]} binary")


def _unsure(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x rounded to DIGITS, half away from 0; where an error of 1e-4 of the last digit, or more digits than doubles hold, could change that)."""
    part = np.abs(x)
    part *= 10.0**DIGITS
    whole = np.floor(part + 0.5)
    far = part < 1e9
    part -= whole
    np.abs(part, out=part)
    far &= part < 0.5 - 1e-4
    whole /= 10.0**DIGITS
    return np.copysign(whole, x, out=whole) + 0.0, ~far


def round_half_up(x: np.ndarray) -> np.ndarray:
    """Doubles rounded to DIGITS as Spark rounds them: half up in their shortest decimal form."""
    with np.errstate(all="ignore"):
        out, unsure = _unsure(x)
    if unsure.any():
        step = Decimal(1).scaleb(-DIGITS)
        with localcontext() as c:
            c.prec = 400
            out[unsure] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) + 0.0 if math.isfinite(v) else v for v in x[unsure].tolist()]
    return out


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x and y, which broadcast; products are added in the order of the entries, as `vectors.dot` adds them."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    with np.errstate(all="ignore"):
        for k in range(x.shape[-1]):
            out += x[..., k] * y[..., k]
    return out


def rounded_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded dot products of every row of x with every row of y.

    They come from a product of matrices, which may add in another order. Where that order could change a rounded
    value (one in 5000), and for vectors so long or so odd that the error is not small, they are added in order.
    """
    length = np.sqrt(np.square(x).sum(1).max(initial=0) * np.square(y).sum(1).max(initial=0))
    if not length < 1e3:
        return np.concatenate([round_half_up(dots(x[i : i + 16, None, :], y[None])) for i in range(0, len(x), 16)])
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):  # pieces that stay in the cache
        out[i : i + 64], unsure = _unsure(x[i : i + 64] @ y.T)
        at, to = np.nonzero(unsure)
        if len(at):
            out[i + at, to] = round_half_up(dots(x[i + at], y[to]))
    return out


def _block_scores(batch: pa.RecordBatch, r: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(query ids, entry ids, rounded scores, where they are null) of the two blocks in a row; queries by entries."""
    ids, n, nulls, body, asked, m, blank, asked_body = (batch.column(k)[r] for k in range(8))
    ids, asked, n, m = ids.values, asked.values, n.as_py(), m.as_py()
    shape = (len(asked), len(ids))
    if n != m:
        return asked, ids, np.zeros(shape), np.full(shape, min(n, m) < 0)
    null = np.frombuffer(blank.as_buffer(), bool)[:, None] | np.frombuffer(nulls.as_buffer(), bool)[None, :]
    if n < 0:
        return asked, ids, np.zeros(shape), np.ones(shape, bool)
    x, y = (np.frombuffer(v.as_buffer(), "f8").reshape(len(i), n) for v, i in ((asked_body, asked), (body, ids)))
    return asked, ids, rounded_dots(x, y), null


def _best(scores: np.ndarray, null: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Mask of the k best entries of every query: greatest score, NaN above all as in Spark, then least id."""
    nan = np.isnan(scores)
    key = np.where(nan, np.inf, scores) if nan.any() else scores.copy()
    key[null] = -np.inf
    n = key.shape[1]
    if n <= k:
        return np.ones(key.shape, bool)
    keep = key >= np.partition(key, n - k, axis=1)[:, n - k, None]
    place = np.empty(n, int)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(n)
    for row in np.flatnonzero(np.count_nonzero(keep, axis=1) > k).tolist():
        at = np.flatnonzero(keep[row])
        order = np.lexsort((place[at], null[row, at], -key[row, at], ~nan[row, at]))
        keep[row, at[order[k:]]] = False
    return keep


def _scored(entries: DataFrame, queries: DataFrame, id_col: str, vec_col: str, run: Callable, schema: str) -> DataFrame:
    """What `run` makes of the pairs of a block of normalised entries and one of queries (query_id, q). Blocks of queries are broadcast, blocks of entries dealt to all tasks."""
    unit = entries.select(F.col(id_col), V.l2_normalize(V.to_double(F.col(vec_col))).alias("v"))
    asked = queries.select("query_id", V.to_double(F.col("q")).alias("q"))
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    passes = max(1, -(-n * max(width, 1) * 8 // QUERY_BYTES))
    blocks = _packed(unit, id_col, "e_").repartition(4 * entries.sparkSession.sparkContext.defaultParallelism)
    out = None
    for k in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
        found = blocks.crossJoin(F.broadcast(_packed(part.coalesce(1), "query_id", "q_"))).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def cosine_scores(entries: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", best: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, score) of every query with every entry. Entries are normalised, queries (query_id, q) are taken as they are.

    best: of each block of entries the so many that a ranking by score and id puts first, so that the ones of all
    entries are among them. least: scores of that or more only.
    """
    kinds = entries.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked, ids, scores, null = _block_scores(batch, r)
                keep = np.ones(scores.shape, bool) if best is None else _best(scores, null, ids, best)
                if least is not None:
                    keep &= ((scores >= least) | np.isnan(scores)) & ~null
                for lo in range(0, len(asked), 64):
                    x, y = np.nonzero(keep[lo : lo + 64])
                    if len(x):
                        columns = [asked.take(pa.array(x + lo)), ids.take(pa.array(y)), pa.array(scores[x + lo, y], mask=null[x + lo, y], from_pandas=False)]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", id_col, "score"])

    return _scored(entries, queries, id_col, vec_col, run, f"query_id {kinds[1]}, `{id_col}` {kinds[0]}, score double")


def cross_scores(entries: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, n, best, worst) over the scores of each query with every entry, taken in each block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked, _, scores, null = _block_scores(batch, r)
                nan = np.isnan(scores)
                high = np.where(nan, np.inf, scores).max(1, where=~null, initial=-np.inf)
                low = scores.min(1, where=~(null | nan), initial=np.inf)
                none = null.all(1)
                high[(nan & ~null).any(1)] = np.nan  # above all in Spark
                low[(nan | null).all(1)] = np.nan
                n = pa.array(np.full(len(asked), scores.shape[1]))
                yield pa.RecordBatch.from_arrays([asked, n, pa.array(high, mask=none, from_pandas=False), pa.array(low, mask=none, from_pandas=False)], ["query_id", "n", "best", "worst"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = _scored(entries, queries, id_col, vec_col, run, f"query_id {kind}, n long, best double, worst double")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.min("worst").alias("worst"))


def nearest(entries: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the k best entries of every query."""
    return _ranked(cosine_scores(entries, queries, id_col, vec_col, best=k), ["query_id"], id_col, k)


def knn(entries: DataFrame, queries: DataFrame, k: int = TOP_K, gate: float = GATE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The best max(3k, 6) candidates, gated, then the best k of them."""
    best = nearest(entries, queries, max(3 * k, 6), id_col, vec_col)
    return best.filter((F.col("score") >= gate) & (F.col("rank") <= k)).select("query_id", id_col, "score", "rank")


def score_gate(hits: DataFrame, threshold: float = GATE) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf): one row for each term of each document."""
    terms = docs.select(id_col, F.explode(X.bm25_tokens(F.col(text_col))).alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.size(F.coalesce(X.bm25_tokens(F.col(text_col)), F.array().cast("array<string>"))).cast("long").alias("len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total_len"), F.avg("len").alias("avg_len"))


def small(df: DataFrame, n: int | None = None) -> DataFrame:
    """The table marked for broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if (df.count() if n is None else n) <= BROADCAST_ROWS else df


def probe(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, id, tf, len): the terms of queries (query_id, query) with their postings and document lengths.

    Words that no query has are dropped before anything is shuffled, and what is left is dealt once, by document.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("query")))).alias("term"))
    n = asked.count()
    words = docs.select(id_col, F.explode(X.bm25_tokens(F.col(text_col))).alias("term"))
    hits = words.join(small(asked.select("term").distinct(), n), "term").repartition(id_col)
    tf = hits.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(document_lengths(docs, id_col, text_col), id_col).join(small(asked, n), "term").select("query_id", "term", id_col, "tf", "len")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score[, rank]) of queries (query_id, query): distinct query terms, scores above 0, the best k.

    Only words of query terms are kept, before anything is shuffled, and they are dealt once, by document, so that
    frequencies, weights and scores of a document come from one task.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("query")))).alias("term")).distinct()
    n = asked.count()
    toks = docs.select(id_col, X.bm25_tokens(F.col(text_col)).alias("t")).filter("t IS NOT NULL")
    lengths = toks.select(id_col, F.size("t").cast("long").alias("len"))
    stats = corpus_stats(lengths).select("n_docs", "avg_len")
    terms = small(asked.select("term").distinct(), n)
    hits = toks.select(id_col, F.size("t").cast("long").alias("len"), F.explode("t").alias("term")).join(terms, "term").repartition(id_col)
    tf = hits.groupBy(id_col, "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = tf.join(small(df, n), "term").crossJoin(F.broadcast(stats)).withColumn("part", part).join(small(asked, n), "term")
    scored = weighed.groupBy("query_id", id_col).agg(F.round(F.sum("part"), DIGITS).alias("score")).filter("score > 0")
    return scored if k is None else _ranked(scored, ["query_id"], id_col, k).select("query_id", id_col, "score", "rank")


def minmax(hits: DataFrame, by: str = "query_id", score: str = "score") -> Column:
    """(x - min) / (max - min) within the list; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(score) - low) / F.when(high == low, 1.0).otherwise(high - low))


def fuse(dense: DataFrame, sparse: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """Full outer union of two hit lists: alpha * minmax(dense) + (1 - alpha) * minmax(sparse), a missing side being 0."""
    d = dense.select("query_id", id_col, minmax(dense).alias("dense"))
    s = sparse.select("query_id", id_col, minmax(sparse).alias("sparse"))
    both = d.join(s, ["query_id", id_col], "full_outer").na.fill(0.0, ["dense", "sparse"])
    return both.withColumn("score", F.round(alpha * F.col("dense") + (1 - alpha) * F.col("sparse"), DIGITS))


def hybrid(entries: DataFrame, vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int = TOP_K, alpha: float = ALPHA, gate: float = GATE, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """Dense candidates max(3k, 6) and BM25's best 3k, fused, gated, the best k; ids that are not in `entries` then drop out."""
    dense = nearest(entries, vectors, max(3 * k, 6), id_col, vec_col)
    best = _ranked(fuse(dense, bm25(docs, queries, 3 * k), id_col, alpha).filter(F.col("score") >= gate), ["query_id"], id_col, k)
    return hydrate(best.select("query_id", id_col, "score", "rank"), entries.select(id_col), id_col)


def hydrate(hits: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """Hits with the store's columns; hits that the store does not have drop out."""
    return hits.join(store, id_col)


def mmr(candidates: DataFrame, k: int, lam: float = MMR_LAMBDA, id_col: str = "vec_id") -> DataFrame:
    """Greedy choice of k candidates (query_id, id, score, v) by lam * relevance - (1 - lam) * nearness to the chosen.

    Nearness is floored at 0, the first of equals wins, and the score that is reported is the relevance.
    The candidates of one query are few (top-k output); their matrix of similarities is computed first,
    and the fold carries positions and scores only.
    """
    row = F.struct(F.negative("score").alias("o"), F.col(id_col).alias("id"), F.col("score").alias("rel"), F.col("v").alias("v"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    near = F.transform("c", lambda x: F.transform("c", lambda y: F.greatest(F.lit(0.0), V.dot(x["v"], y["v"]))))
    flat = lists.select("query_id", F.transform("c", lambda x: x["id"]).alias("ids"), F.transform("c", lambda x: x["rel"]).alias("rels"), near.alias("near"))

    def step(chosen, _):
        def value(i):
            nearest = F.aggregate(chosen, F.lit(0.0), lambda m, j: F.greatest(m, F.get(F.get("near", j), i)))
            return F.round(F.lit(lam) * F.get("rels", i) - F.lit(1 - lam) * nearest, 9)

        left = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.array_contains(chosen, i))
        best = F.array_max(F.transform(left, lambda i: F.struct(value(i).alias("s"), (-i).alias("i"))))
        return F.when(F.size(left) == 0, chosen).otherwise(F.concat(chosen, F.array(-best["i"])))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<int>"), step)
    out = flat.select("query_id", "ids", "rels", F.posexplode(picked).alias("at", "i"))
    return out.select("query_id", F.get("ids", "i").alias(id_col), F.get("rels", "i").alias("score"), (F.col("at") + 1).alias("rank"))
