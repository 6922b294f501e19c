"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of five words. The sketch throws every shingle into a random
bin in each of t rounds, then into one fixed bin in each of t more, and keeps for each bin the smallest
round-and-hash; bins fill after a few rounds for all but the smallest sets, every bin is sure to be
filled, and equal bins estimate similarity with concentration bounds. Bands of the sketch name buckets.

1. Documents with equal sets form a class (its id: the smallest doc_id). Only classes go on.
2. Members of a bucket are linked with its smallest; connected components of these links are clusters.
3. Each cluster is verified on its members' full shingle sets. A cluster of more than BLOCK_DOCS documents or
   BLOCK_SHINGLES shingles is cut into blocks, and every pair of blocks is a task of its own, so no task
   holds a whole large cluster, be it of many documents or of very long ones.
   All pairs whose sizes permit a link are compared; only links that join something are emitted.
4. Components of the verified links are the groups.

Shingles are compared by 64-bit hashes. With the default bands a pair at the threshold is missed with a
probability below one in a million, a more similar one with less.

Edge cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words
make one shingle; repeated rows come back once each and belong together, as do different rows of one
doc_id; rows without a doc_id link with nothing, their component is null and they are kept; an empty
table gives none; texts of any length are sketched and compared whole, one document's set being what a task
has to hold at least; a group's component is its least doc_id, so ties do not arise; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.components import components

SHINGLE = 5
#: Documents of a cluster, and shingles of all its documents, that are compared in one task; larger clusters are cut into blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 4 << 20
#: Entries of the matrices that compare two tiles of sets; larger ones are counted without matrices.
CELLS = 16 << 20
#: Up to so many candidate ids are broadcast to the scan of texts; beyond that, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_REMEMBERED = 200_000
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, SHINGLE + 1)], _U)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, known: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    h = np.fromiter(map(known.__getitem__, words), _U, n)
    if n < SHINGLE:
        return mix((h * _POWERS[:n]).sum(keepdims=True) + _U(n))
    total = h[: n - SHINGLE + 1] * _POWERS[0]
    for k in range(1, SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * _POWERS[k]
    return np.unique(mix(total))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t values for each set; rows of empty sets stay at the maximum."""
    none = np.iinfo("u8").max
    out = np.full((len(sets), t), none, _U)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ mix(np.array([i + 1], _U) * _U(0x9E3779B97F4A7C15)))
        place = (h % _U(t)).astype("i8") if i < t else i - t
        np.minimum.at(flat, doc * t + place, _U(i) << _U(48) | h >> _U(16))
        if i < 4 or i % 8 == 0 or i >= t:
            live = (out[doc] == none).any(1) if len(x) < 4096 else np.isin(doc, np.flatnonzero((out == none).any(1)))
            doc, x = doc[live], x[live]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` values; keys of different bands differ."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(_U)), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view("i8")


def sketch_documents(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that name the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingles(t, known) for t in batch.column(1).to_pylist()]
            keys = band_keys(sketches(sets, bands * rows), rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([k if len(s) else [] for k, s in zip(keys.tolist(), sets)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


class _Sets:
    """Groups of linked members, by union and find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two small lists of sorted sets: by a product of membership matrices over the rows' values, of long sets by counting them."""
    values = np.unique(np.concatenate(rows))
    if len(values) * (len(rows) + len(cols)) > CELLS:
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(s) for s in rows])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = np.zeros((len(rows), len(cols)), "i8")
        for k, s in enumerate(cols):
            lo = np.searchsorted(flat, s, "left")
            times = np.searchsorted(flat, s, "right") - lo
            at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            out[:, k] = np.bincount(owner[at], minlength=len(rows))
        return out
    m = np.zeros((len(rows), len(values)), "f4")
    for k, s in enumerate(rows):
        m[k, np.searchsorted(values, s)] = 1
    w = np.zeros((len(cols), len(values)), "f4")
    for k, s in enumerate(cols):
        at = np.searchsorted(values, s)
        at[at == len(values)] = 0
        w[k, at[values[at] == s]] = 1
    return np.rint(m @ w.T).astype("i8")


def links(sets: list[np.ndarray], side: np.ndarray, percent: int, tile: int = 64) -> list[tuple[int, int]]:
    """Pairs with 100 * intersection >= percent * union that connect all linked members; side: only pairs with sides 0 and 1, or -1: any."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    groups, found = _Sets(n), []
    order = np.argsort(size, kind="stable")
    tiles = [order[lo : lo + tile] for lo in range(0, n, tile)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        if len({groups.find(int(i)) for i in (*a, *b)}) == 1:
            return
        inter = _overlaps([sets[i] for i in a], [sets[i] for i in b])
        ok = 100 * inter >= percent * (size[a][:, None] + size[b][None] - inter)
        ok &= (side[a][:, None] != side[b][None]) | (side[a][:, None] < 0)
        for i, j in zip(*np.nonzero(ok)):
            i, j = int(a[i]), int(b[j])
            if i != j and groups.join(i, j):
                found.append((i, j))

    for t in tiles:  # a middle member first: in a group of close copies it links nearly all
        mid = order[n // 2 : n // 2 + 1]
        compare(mid, t)
    for p, a in enumerate(tiles):
        for b in tiles[p:]:
            if 100 * size[a[-1]] < percent * size[b[0]]:
                break
            compare(a, b)
    return found


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in each task's members. rows: task, side, cid, text; tasks arrive whole and in order."""

    def solve(task: list[tuple]) -> list[tuple[int, int]]:
        pairs = links([t[2] for t in task], np.array([t[0] for t in task]), percent)
        return [(task[i][1], task[j][1]) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, known = None, [], _WordHashes()

        def out() -> pa.RecordBatch:
            got = solve(members)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, side, cid, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if task != now:
                    if len(members) > 1:
                        yield out()
                    now, members = task, []
                members.append((side, cid, shingles(text.as_py(), known)))  # one text at a time
        if len(members) > 1:
            yield out()

    dealt = rows.select("task", "side", "cid", "text").repartition("task").sortWithinPartitions("task", "cid")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs. See the module's docstring."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = common.staged(sketch_documents(source, bands, rows), "sketches")
    usable = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.staged(usable.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "classes")
    keys = classes.select("cid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).filter("leader < last")
    buckets = common.staged(buckets, "buckets")  # a table of its own, so that a hot bucket is split in the join
    stars = keys.join(buckets.select("key", "leader"), "key").filter("cid <> leader").select("cid", "leader").distinct()
    cluster_of = common.staged(components(stars, "cid", "leader").select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "clusters")
    sizes = cluster_of.join(classes.select("cid", "n_shingles"), "cid").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"))
    small = (F.col("n") <= BLOCK_DOCS) & (F.col("held") <= BLOCK_SHINGLES)
    blocks = F.greatest(F.ceil(F.col("n") * 2 / F.lit(BLOCK_DOCS)), F.least(F.ceil(F.col("held") * 2 / F.lit(BLOCK_SHINGLES)), F.col("n")))
    sizes = common.staged(sizes.select("cluster", F.when(small, 1).otherwise(blocks).cast("int").alias("blocks")), "cluster-sizes")
    members = cluster_of.join(sizes, "cluster").select("cid", "cluster", "blocks")
    few = cluster_of.count() <= BROADCAST_IDS
    wanted = F.broadcast(members) if few else members
    texts = source.join(wanted, source["doc_id"] == wanted["cid"]).select("cid", "cluster", "blocks", "text")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("task", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")))
    verified = common.staged(_verify(dealt, percent), "links")
    common.discard(classes)
    groups = components(verified, "a", "b").select(F.col("node").alias("cid"), "component")

    class_of = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("cid"))
    named = common.staged(class_of.join(groups, "cid", "left").select("set_key", F.coalesce("component", "cid").alias("component")), "groups")
    found = drawn.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """Groups of documents at a similarity of 0.85 or more; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    return near_duplicates(docs, percent=85, bands=25, rows=5)


QUERIES = {"op6_minhash": op6_minhash}
ORACLES = {
    "op6_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m),
        g AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM g LEFT JOIN n USING (doc_id)""",
}
