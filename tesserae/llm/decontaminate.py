"""Benchmark decontamination with suffix arrays over the training words.

Training documents are dealt to shards of a few megabytes. Each shard numbers its words by the
benchmark's vocabulary, keeps the runs of known words long enough to hold a window, and sorts the
suffixes of those runs by prefix doubling. Every test suffix (each place in each item) is then
binary-searched in the shard: the place in the order gives its longest verbatim match, and for
windows the whole interval of equal prefixes, that is, all locations. Words inside any occurrence are hit.

The benchmark reaches the shards by broadcast in blocks of at most BLOCK_BYTES; a larger benchmark
takes more passes over the documents instead of a larger broadcast. Each pass writes what it found and
lets go of its block; passes are put together by a number that every document row gets once.

Edge cases: null and empty texts have no words; texts and items of any length are searched whole; an
item without words has no window; repeated items count once each by item_id; repeated document rows, and
rows without a doc_id, give one row each with their own counts; an empty benchmark hits nothing; item ids
that are null are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and whatever is not ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass
class Tests:
    """A block of test items: vocabulary, their words laid end to end, all their suffixes, and their windows."""

    vocabulary: dict[bytes, int]
    flat: np.ndarray  # word numbers of the distinct items, a 0 behind each
    starts: np.ndarray  # of every suffix
    lengths: np.ndarray
    windows: np.ndarray  # suffixes that begin a window, no content twice
    window_len: np.ndarray
    owners: list[list[str]]  # items of each window

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Tests:
        vocabulary: dict[bytes, int] = {}
        coded = [(i, tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)) for i, words in items if words]
        places: dict[tuple[int, ...], int] = {}
        flat, starts, lengths, first = [], [], [], {}
        for _, c in coded:
            if c not in places:
                places[c], first[c] = len(flat), len(starts)
                starts += range(len(flat), len(flat) + len(c))
                lengths += range(len(c), 0, -1)
                flat += [*c, 0]
        owners, heads = {}, {}
        for item, c in coded:
            size = min(window, len(c))
            for s in range(len(c) - size + 1):
                key = c[s : s + size]
                heads.setdefault(key, first[c] + s)
                owners.setdefault(key, set()).add(item)
        keys = list(heads)
        return cls(vocabulary, np.array(flat, "i4"), np.array(starts, int), np.array(lengths, int), np.array([heads[k] for k in keys], int), np.array([len(k) for k in keys], int), [sorted(owners[k]) for k in keys])

    @property
    def longest(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 0


def suffix_array(a: np.ndarray, deep: int) -> np.ndarray:
    """Order of the suffixes of `a` by their first `deep` values at least; beyond the end stands 0."""
    rank = np.unique(a, return_inverse=True)[1].astype("i8") if len(a) else np.zeros(0, "i8")
    k = 1
    while k < deep and len(a):
        ahead = np.zeros_like(rank)
        ahead[: len(a) - k] = rank[k:] + 1
        values, inverse = np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)
        rank = inverse.astype("i8")
        if len(values) == len(a):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def _compare(text: np.ndarray, at: np.ndarray, flat: np.ndarray, start: np.ndarray, depth: np.ndarray, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(sign of text suffix minus test suffix within depth words, length of the common prefix) row by row.

    Rows are compared `step` words at a time for as long as they agree.
    """
    sign, shared, rows, done = np.zeros(len(at), int), np.zeros(len(at), int), np.arange(len(at)), 0
    while len(rows):
        cols = done + np.arange(step)
        got = text[np.minimum(at[rows, None] + cols, len(text) - 1)]
        want = flat[np.minimum(start[rows, None] + cols, len(flat) - 1)]
        differ = (got != want) | (cols >= depth[rows, None])
        first, ends = differ.argmax(1), differ.any(1)
        here, place = rows[ends], first[ends]
        shared[here] = np.minimum(done + place, depth[here])
        k = np.flatnonzero(ends)
        sign[here] = np.where(done + place >= depth[here], 0, np.sign(got[k, place].astype(int) - want[k, place]))
        rows, done = rows[~ends], done + step
    return sign, shared


def _bisect(text: np.ndarray, order: np.ndarray, flat: np.ndarray, start: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
    """Place of each test suffix among the sorted suffixes, compared on `depth` words: before or behind equals."""
    lo, hi = np.zeros(len(start), int), np.full(len(start), len(order))
    while (open_ := lo < hi).any():
        rows = np.flatnonzero(open_)
        mid = (lo[rows] + hi[rows]) // 2
        sign, _ = _compare(text, order[mid], flat, start[rows], depth[rows])
        up = sign <= 0 if right else sign < 0
        lo[rows[up]] = mid[up] + 1
        hi[rows[~up]] = mid[~up]
    return lo


class Shard:
    """The suffix array of some documents' words, as far as they can match."""

    def __init__(self, docs: list[list[bytes]], tests: Tests):
        self.tests = tests
        get = tests.vocabulary.get
        least = int(tests.window_len.min()) if len(tests.window_len) else 1
        ids = np.concatenate([np.array([get(w, 0) for w in d] + [0], "i4") for d in docs]) if docs else np.zeros(0, "i4")
        self.bounds = np.cumsum([0] + [len(d) + 1 for d in docs])
        edge = np.diff(np.concatenate([[0], (ids != 0).astype("i1"), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = end - begin >= least
        begin, end = begin[keep], end[keep]
        sizes = end - begin + 1  # a 0 ends each run
        ends = np.cumsum(sizes)
        self.place = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)  # in ids
        self.text = np.concatenate([ids[self.place] if len(self.place) else np.zeros(0, "i4"), np.zeros(1, "i4")])
        if len(ends):
            self.text[ends - 1] = 0
        used = self.text[: len(self.place)]
        order = suffix_array(used, tests.longest)
        self.order = order[used[order] != 0]
        self.size = len(ids)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the length of its longest match here and where that begins (-1: no match)."""
        t = self.tests
        best, where = np.zeros(len(t.starts), int), np.full(len(t.starts), -1)
        if not len(self.order) or not len(t.starts):
            return best, where
        at = _bisect(self.text, self.order, t.flat, t.starts, t.lengths, False)
        for near in (at - 1, at):
            ok = (near >= 0) & (near < len(self.order))
            pos = self.order[np.clip(near, 0, len(self.order) - 1)]
            _, shared = _compare(self.text, pos, t.flat, t.starts, t.lengths)
            better = ok & (shared > best)
            best[better], where[better] = shared[better], self.place[pos[better]]
        return best, where

    def hits(self) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """(which words are hit, (document, window) pairs, longest match of each document)."""
        t = self.tests
        covered = np.zeros(self.size + 1, int)
        pairs: list[tuple[int, int]] = []
        if len(self.order) and len(t.windows):
            best, _ = self.longest()
            live = np.flatnonzero(best[t.windows] >= t.window_len)
            start, depth = t.starts[t.windows[live]], t.window_len[live]
            lo = _bisect(self.text, self.order, t.flat, start, depth, False)
            hi = _bisect(self.text, self.order, t.flat, start, depth, True)
            for w, a, b, n in zip(live.tolist(), lo, hi, depth):
                at = self.place[self.order[a:b]]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + n, -1)
                pairs += [(d, w) for d in np.unique(np.searchsorted(self.bounds, at, "right") - 1).tolist()]
        return np.cumsum(covered)[:-1] > 0, pairs, self.bounds


def find_overlaps(docs: DataFrame, tests: Tests, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, spans of hit words as (begin, end) pairs, and the ids of items with occurring windows."""
    schema = "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        t = shared.value
        hit, pairs, bounds = Shard(texts, t).hits()
        items: list[set] = [set() for _ in ids]
        for d, w in pairs:
            items[d].update(t.owners[w])
        edge = np.diff(np.concatenate([[0], hit.astype("i1"), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = np.searchsorted(begin, bounds)
        spans = [[{"begin": int(b - bounds[k]), "end": int(e - bounds[k])} for b, e in zip(begin[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]])] for k in range(len(ids))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(d) for d in texts], pa.int64()), pa.array(spans, span_type), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
            ["doc_id", "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(words_of(t))
                size += len(t or "")
                if size >= SHARD_BYTES:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield answer(ids, texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()


def count_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """In how many blocks the benchmark's texts come when each has about block_bytes at most."""
    total = _items(benchmark, item_col, text_col).agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-total // block_bytes))


def test_blocks(benchmark: DataFrame, blocks: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[Tests]:
    """The benchmark in so many blocks, fetched one after another."""
    items = _items(benchmark, item_col, text_col)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        yield Tests.of([(r["i"], words_of(r["t"])) for r in part.orderBy("i", "t").toLocalIterator()])


def _summary(found: DataFrame, item_filter: bool = True) -> DataFrame:
    joined = F.array_join(F.array_sort("items"), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    longest = F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"] - x["begin"])), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), longest.alias("longest_run"))


def _touching(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<begin:long,end:long>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (last(acc)["end"] >= x["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def overlap_report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """find_overlaps over all blocks of the benchmark: one row for each row of docs, whatever the number of blocks."""
    blocks = count_blocks(benchmark, block_bytes=block_bytes)
    if blocks == 1:
        return find_overlaps(docs, next(test_blocks(benchmark, blocks)))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.staged(rows, "numbered")  # numbers stay as they are once written
    parts = None
    for tests in test_blocks(benchmark, blocks):
        found = find_overlaps(rows, tests, id_col="_row").withColumnRenamed("doc_id", "_row")
        part = common.staged(found if parts is None else found.filter("size(spans) > 0"), "block-hits")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return rows.select("_row", "doc_id").join(merged, "_row").select("doc_id", "n_words", _touching(F.col("spans")).alias("spans"), "items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that no benchmark window touches."""
    out = docs
    names, at = docs.columns, docs.columns.index(text_col)
    blocks = count_blocks(benchmark, block_bytes=block_bytes)
    for tests in test_blocks(benchmark, blocks):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, pairs, _ = Shard([words_of(t) for t in batch.column(at).to_pylist()], shared.value).hits()
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in pairs]] = False
                yield batch.filter(pa.array(keep))

        out = out.select(*names).mapInArrow(run, docs.schema)
        if blocks > 1:
            out = common.staged(out, "clean")
            shared.destroy()
    return out


def op10_suffix_decontamination(spark, sf_dir, docs: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """Benchmark overlap of every document; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    benchmark = common.documents(spark, sf_dir, "benchmark") if benchmark is None else benchmark
    return _summary(overlap_report(docs, benchmark))


QUERIES = {"op10_suffix_decontamination": op10_suffix_decontamination}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op10_suffix_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT DISTINCT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
        hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, k)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY 1),
        runs AS (SELECT doc_id, max(c) AS longest_run FROM (SELECT doc_id, count(*) AS c FROM (
            SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits)) GROUP BY doc_id, g) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest_run, 0) AS longest_run
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)""",
}
