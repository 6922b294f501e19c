"""Centroid clustering of integer vectors by Lloyd's rounds with Hamerly's bounds.

Every vector keeps one upper bound on the distance to its centroid and one lower bound on the distance
to any other. Each round loosens both by how far the centroids drifted; a vector whose upper bound stays
below its lower one (or below half the way to the next centroid) keeps its cluster unread, the others
first get their exact distance and, if still ambiguous, an exact integer scan of all centroids. Bounds
are rounded outwards, so they never decide a tie. A round writes its table to the shared folder, and the
sums behind the centroids are carried on exactly by the vectors that changed cluster.

What the driver holds is k centroids, k sums and k counts, whatever the number of vectors; sums of tasks
meet in one aggregation by cluster and component.

Edge cases: null vectors, vectors of another length and vectors with a null or non-finite component are
left out, and so are those with a component beyond +-LARGEST, whose squared distances have no 64-bit form;
with fewer than k vectors each is a centroid; rows without an id count but come last in the choice of
first centroids; repeated ids are rows of their own, equal hashes going by the vector; ties go to the
smaller number; an inertia beyond 64 bits is null; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
LARGEST = 1 << 21
_SLACK = 1e-12  # relative room for rounding of square roots and sums

_STATE = "vec_id long, q array<int>, cluster int, was int, upper double, lower double, distance long"


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, q): floor(SCALE * x) of the components of the vectors that count."""
    v = F.col(vec_col).cast("array<double>")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    return rows.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("int")).alias("q"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the least hashes of seed and id."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("q", rank.alias("_h")).orderBy(F.col("_h").asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([r["q"] for r in rows], np.int64)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of q to each row of c; components up to 2**27 fit 64 bits."""
    return (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None]


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - _SLACK)


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound by a full scan; the smaller number wins a tie."""
    d = squared(q, c)
    own = d.argmin(1)
    best = d[np.arange(len(q)), own]
    d[np.arange(len(q)), own] = np.iinfo(np.int64).max
    lower = _down(np.sqrt(d.min(1).astype("f8"))) if len(c) > 1 else np.full(len(q), np.inf)
    return own, _up(np.sqrt(best.astype("f8"))), lower


def reassign(q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds after the centroids drifted to c, and how many vectors were scanned in full."""
    own, between = own.copy(), squared(c, c)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = _down(np.sqrt(between.min(1).astype("f8")) / 2) if len(c) > 1 else np.full(1, np.inf)
    order = np.argsort(drift)
    others = np.full(len(c), drift[order[-1]])
    others[order[-1]] = drift[order[-2]] if len(c) > 1 else 0.0
    upper, lower = _up(upper + drift[own]), _down(lower - others[own]) - _SLACK
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[own]))
    if len(open_):
        gap = q[open_] - c[own[open_]]
        upper[open_] = _up(np.sqrt((gap * gap).sum(1).astype("f8")))
        open_ = open_[upper[open_] >= np.maximum(lower[open_], half[own[open_]])]
    if len(open_):
        own[open_], upper[open_], lower[open_] = nearest(q[open_], c)
    return own, upper, lower, len(open_)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """Every vector with its cluster, the one it was in, its bounds and its exact squared distance. Without drift all are scanned."""
    dim = centroids.shape[1]
    names = [p.split()[0] for p in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            q = _matrix(b.column(1), dim)
            if drift is None:
                was = np.full(len(q), -1)
                own, upper, lower = nearest(q, centroids)
            else:
                was, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                own, upper, lower, _ = reassign(q, was.astype(np.int64), upper, lower, centroids, drift)
            gap = q - centroids[own]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array((gap * gap).sum(1), pa.int64())],
                names,
            )

    kept = ["vec_id", "q"] if drift is None else ["vec_id", "q", "cluster", "upper", "lower"]
    return state.select(*kept).mapInArrow(run, _STATE)


def moves(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed cluster add to the sums (k x dim, exact) and counts of the clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, some = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), False
        for b in batches:
            if len(b):
                q, some = _matrix(b.column(0), dim), True
                for side, sign in ((1, 1), (2, -1)):
                    at = b.column(side).to_numpy(zero_copy_only=False)
                    into = at >= 0
                    np.add.at(sums, at[into], sign * q[into])
                    np.add.at(counts, at[into], sign)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.filter("cluster <> was").select("q", "cluster", "was").mapInArrow(run, "cluster int, n long, sums array<long>")
    one = parts.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("sums"))).alias("at", "v"))
    total = one.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()  # k * (dim + 1) rows
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    for r in total:
        if r["at"]:
            sums[r["cluster"], r["at"] - 1] = int(r["v"])
        else:
            counts[r["cluster"]] = int(r["v"])
    return sums, counts


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, distance, ...) after `rounds` rounds and one more assignment, and the centroids. vectors is what quantised gives."""
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _STATE), centroids
    n, dim = centroids.shape
    state, drift = vectors, None
    sums, counts = np.zeros((n, dim), object), np.zeros(n, object)
    for left in range(rounds, -1, -1):
        before, state = state, common.staged(assign(state, centroids, drift), "clusters")
        common.discard(before)
        if left:
            more, count = moves(state, n, dim)
            sums, counts = sums + more, counts + count
            new = np.array([[int(v) // int(m) for v in s] if m else c for s, m, c in zip(sums, counts, centroids.tolist())], np.int64)
            gap = new - centroids
            centroids, drift = new, _up(np.sqrt((gap * gap).sum(1).astype("f8")))
    return state, centroids


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def op11_centroid_clusters(spark, sf_dir, embeddings: DataFrame | None = None) -> DataFrame:
    """Cluster and squared distance of every vector, inertias and the digest of its centroid; see the module's docstring."""
    common.prepare(spark)
    rows = common.documents(spark, sf_dir, "embeddings") if embeddings is None else embeddings
    state, centroids = cluster(quantised(rows))
    found = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()  # k rows
    inertia = {r["cluster"]: int(r["d"]) for r in found}
    facts = [(j, _long(inertia.get(j, 0)), _long(sum(inertia.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(rounds: int) -> str:
    out = ""
    for n in range(rounds + 1):
        out += f""",
        a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': (qq - 2 * list_dot_product(q, c) + list_dot_product(c, c))::BIGINT, 'j': j}}) AS m
            FROM k, c{n} GROUP BY r)"""
        if n < rounds:
            out += f""",
        s{n} AS (SELECT m.j AS j, unnest(q) AS v, generate_subscripts(q, 1) AS dim FROM a{n}),
        u{n} AS (SELECT j, list(v ORDER BY dim) AS c FROM (SELECT j, dim, floor(sum(v) / count(*))::DOUBLE AS v FROM s{n} GROUP BY ALL) GROUP BY j),
        c{n + 1} AS MATERIALIZED (SELECT j, coalesce(u{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN u{n} USING (j))"""
    return out


QUERIES = {"op11_centroid_clusters": op11_centroid_clusters}
ORACLES = {
    "op11_centroid_clusters": f"""
        WITH k AS MATERIALIZED (
            SELECT *, row_number() OVER () AS r, list_dot_product(q, q) AS qq FROM (
                SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
                WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x) <= {LARGEST})) = {DIM})),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS j, q AS c FROM k QUALIFY j < {CLUSTERS}){_rounds(ROUNDS)}
        SELECT vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} ON j = m.j""",
}
