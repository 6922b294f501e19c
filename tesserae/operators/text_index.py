"""A stored BM25 index: postings in blocks with bounds, removal by tombstones, top-k that skips blocks.

A segment holds the documents of one put. They are dealt to tasks by their ids, and a task makes slices of
SLICE_DOCS of them; a block has a term's postings of one slice, with the greatest frequency and the least
length in it, from which a bound on any score follows whatever the corpus statistics and parameters are at
the time of asking. The block without a term names the slice's documents and their lengths. So texts are
moved once and blocks are written where they are made. Blocks are bucketed by term, so a question reads the
buckets of its terms only, and bounds are columns of their own, so they are read without the postings.

Search first scores the slices of the k greatest bounds, which gives each question a score that its k-th
hit has at least; slices whose bound is below are skipped, the others are scored. A slice is scored for all
questions that want it at once, as a product of matrices, and only hits that can be among the k best leave it.
A removed document is a tombstone of its slice, which takes its terms out of the document frequencies at once
and hides its postings on read. Slices of all segments have different numbers, so a document that is put
again lies in another slice than its tombstone. Every put or removal is one commit, so a reader sees all of
it or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators.retrieval import BROADCAST_ROWS, DIGITS, K1, B, _best, round_half_up, small
from tesserae.sources.snapshots import Folder, Manifests

#: Documents of a slice, and folders that terms are dealt to.
SLICE_DOCS, BUCKETS = 128, 32
#: Folder of the blocks that name a slice's documents.
DOCUMENTS = -1
#: Up to so many tombstones are broadcast; beyond, they are joined by a shuffle.
BROADCAST_DEAD = 4_000_000
_SLACK = 10.0**-DIGITS  # scores are rounded, so a bound may be so much too low


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), DOCUMENTS).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def _blocks(ids: pa.Array, tokens: pa.ListArray, number: int) -> pa.RecordBatch:
    """term, slice, max_tf, min_len, postings (doc_id, tf, len) of the documents of one slice; first the block that names them."""
    n, lengths = len(ids), tokens.value_lengths().to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    key, tf = np.unique(key, return_counts=True)
    code, doc = key // n, key % n
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    max_tf = np.maximum.reduceat(tf, begins) if len(begins) else tf
    min_len = np.minimum.reduceat(lengths[doc], begins) if len(begins) else tf
    doc, tf = np.append(np.arange(n), doc), np.append(np.zeros(n, int), tf)
    row = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(lengths[doc], pa.int32())], ["doc_id", "tf", "len"])
    terms = pa.concat_arrays([pa.nulls(1, words.dictionary.type), words.dictionary.take(pa.array(code[begins]))])
    offsets = pa.array(np.concatenate([[0], n + begins, [n + len(key)]]), pa.int32())
    least = lengths.min()
    columns = [terms, pa.array(np.full(len(terms), number)), pa.array(np.append(0, max_tf), pa.int32()), pa.array(np.append(least, min_len), pa.int32()), pa.ListArray.from_arrays(offsets, row)]
    return pa.RecordBatch.from_arrays(columns, ["term", "slice", "max_tf", "min_len", "postings"])


def _slice_scores(blocks: pa.StructArray, query: np.ndarray, term: np.ndarray, idf: np.ndarray, wanted: np.ndarray, k1: float, b: float, avg: float) -> tuple[pa.Array, np.ndarray]:
    """(documents, rounded scores of the wanted questions) of a slice. blocks: number of a term, postings; query, term, idf: weights by number of the term."""
    numbers, postings = blocks.field("number").to_numpy(), blocks.field("postings")
    rows, counts = postings.flatten(), postings.value_lengths().to_numpy(zero_copy_only=False)
    found = rows.field("doc_id").dictionary_encode()
    tf, length = (rows.field(c).to_numpy().astype(float) for c in ("tf", "len"))
    parts = np.zeros((len(numbers), len(found.dictionary)))
    parts[np.repeat(np.arange(len(numbers)), counts), found.indices.to_numpy()] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))
    # the weights of these terms for these questions
    lo, hi = np.searchsorted(term, numbers, "left"), np.searchsorted(term, numbers, "right")
    times = hi - lo
    at = np.arange(times.sum()) + np.repeat(lo - (np.cumsum(times) - times), times)
    to = np.searchsorted(wanted, query[at])
    own = (to < len(wanted)) & (wanted[np.minimum(to, len(wanted) - 1)] == query[at])
    weights = np.zeros((len(wanted), len(numbers)))
    np.add.at(weights, (to[own], np.repeat(np.arange(len(numbers)), times)[own]), idf[at[own]])
    return found.dictionary, round_half_up(weights @ parts)


@dataclass
class Pruning:
    """What a search read: pairs of question and slice that it could have scored, and those that it did."""

    slices: int
    scored: int

    @property
    def skipped(self) -> int:
        return self.slices - self.scored


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, slice_docs: int = SLICE_DOCS):
        self.spark, self.slice_docs = spark, slice_docs
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def _read(self, manifest: dict, table: str, kinds: tuple[str, ...]) -> DataFrame | None:
        out = None
        for s in manifest["segments"]:
            if s["kind"] in kinds:
                df = self.spark.read.parquet(f"{self.folder.root}/{s['path']}/{table}")
                out = df if out is None else out.unionByName(df)
        return out

    def _write(self, df: DataFrame, path: str, table: str, by: str | None = None) -> DataFrame:
        where = f"{self.folder.root}/{path}/{table}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _live(self, manifest: dict, blocks: DataFrame) -> DataFrame:
        """Blocks without the postings that tombstones name, and without those that have none left. Their bounds stay: they hold for fewer postings too."""
        dead = self._read(manifest, "dead", ("buried",))
        if dead is None:
            return blocks
        n = -sum(s["n_docs"] for s in manifest["segments"] if s["kind"] == "buried")
        dead = dead.groupBy(F.col("slice").alias("_slice")).agg(F.flatten(F.collect_list("ids")).alias("_dead"))
        left = F.when(F.col("_dead").isNull(), F.col("postings")).otherwise(F.filter("postings", lambda p: ~F.array_contains("_dead", p["doc_id"])))
        found = blocks.join(F.broadcast(dead) if n <= BROADCAST_DEAD else dead, F.col("slice") == F.col("_slice"), "left").withColumn("postings", left)
        return found.drop("_slice", "_dead").filter(F.size("postings") > 0)

    def _bury(self, manifest: dict, ids: DataFrame, seq: int) -> dict | None:
        """A segment of tombstones for the indexed ones of the ids, with what they take from the statistics."""
        blocks = self._read(manifest, "blocks", ("rows",))
        if blocks is None:
            return None
        path = f"data/{uuid.uuid4().hex}"
        docs = self._live(manifest, blocks.filter(F.col("bucket") == DOCUMENTS)).select("slice", F.inline("postings"))
        gone = docs.join(ids.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi")
        gone = self._write(gone.groupBy("slice").agg(F.collect_list("doc_id").alias("ids"), F.sum("len").alias("total_len")), path, "dead")
        n, total = gone.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("total_len"), F.lit(0))).first()
        if not n:
            return None
        hit = blocks.filter(F.col("bucket") != DOCUMENTS).join(F.broadcast(gone) if n <= BROADCAST_DEAD else gone, "slice")
        hit = hit.select("term", F.size(F.array_intersect("postings.doc_id", "ids")).cast("long").alias("n")).filter("n > 0")
        self._write(hit.groupBy("term").agg(F.negative(F.sum("n")).alias("df")), path, "df")
        return {"path": path, "kind": "buried", "seq": seq, "n_docs": -int(n), "total_len": -int(total)}

    def _segment(self, path: str, blocks: DataFrame, seq: int) -> dict:
        """Writes blocks (term, slice, max_tf, min_len, postings) and document frequencies of a segment."""
        blocks = self._write(blocks.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "slice"), path, "blocks", "bucket")
        own = blocks.filter(F.col("bucket") == DOCUMENTS).select(F.inline("postings"))
        n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not n:
            return {"n_docs": 0}
        counted = blocks.filter(F.col("bucket") != DOCUMENTS).select("term", F.size("postings").cast("long").alias("n"))
        self._write(counted.groupBy("term").agg(F.sum("n").alias("df")), path, "df")
        return {"path": path, "kind": "rows", "seq": seq, "n_docs": n, "total_len": int(total)}

    def put(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Indexes documents, those that the index has anew; of repeated ids the least text counts. Rows without an id or text are left out. Gives the new version."""
        base, manifest = self.manifests.load()
        path, slice_docs = f"data/{uuid.uuid4().hex}", self.slice_docs
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
        once = rows.filter("doc_id IS NOT NULL AND _t IS NOT NULL")
        repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
        n = repeated.count()
        if n:  # texts are compared for these ids only
            least = once.join(small(repeated, n), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_t").alias("_t"))
            once = once.join(small(repeated, n), "doc_id", "left_anti").unionByName(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = (base + 1 << 44) + (TaskContext.get().partitionId() << 20)
            for batch in batches:
                for lo in range(0, batch.num_rows, slice_docs):
                    yield _blocks(batch.column(0).slice(lo, slice_docs), batch.column(1).slice(lo, slice_docs), number)
                    number += 1

        kind = once.schema["doc_id"].dataType.simpleString()
        tokens = once.repartition("doc_id").select("doc_id", X.bm25_tokens(F.col("_t")).alias("t"))
        blocks = tokens.mapInArrow(run, f"term string, slice long, max_tf int, min_len int, postings array<struct<doc_id:{kind},tf:int,len:int>>")
        segment = self._segment(path, blocks, base + 1)
        if not segment["n_docs"]:
            return base
        own = self._read({"segments": [segment]}, "blocks", ("rows",)).filter(F.col("bucket") == DOCUMENTS).select(F.inline("postings"))
        buried = self._bury(manifest, own, base + 1)
        return self.manifests.commit(base, {"segments": [*manifest["segments"], *([buried] if buried else []), segment]})

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Takes documents out and gives the new version; ids that the index does not have change nothing."""
        base, manifest = self.manifests.load()
        buried = self._bury(manifest, ids.select(F.col(id_col).alias("doc_id")), base + 1)
        return self.manifests.commit(base, {"segments": [*manifest["segments"], buried]}) if buried else base

    def stats(self, version: int | None = None) -> tuple[int, int]:
        """(documents, tokens)."""
        _, manifest = self.manifests.load(version)
        return sum(s["n_docs"] for s in manifest["segments"]), sum(s["total_len"] for s in manifest["segments"])

    def document_frequency(self, version: int | None = None) -> DataFrame:
        """(term, df) of the terms that some document has."""
        _, manifest = self.manifests.load(version)
        df = self._read(manifest, "df", ("rows", "buried"))
        if df is None:
            return self.spark.createDataFrame([], "term string, df long")
        return df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def search(self, queries: DataFrame, k: int, k1: float = K1, b: float = B, version: int | None = None) -> tuple[DataFrame, Pruning]:
        """(query_id, doc_id, score, rank) of the k best documents of each question (query_id, query), and what was read for it."""
        from tesserae.sources.tables import scratch

        version, manifest = self.manifests.load(version)
        n, total = self.stats(version)
        empty = self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        if not n or not total:
            return empty, Pruning(0, 0)

        def staged(df: DataFrame, label: str) -> DataFrame:
            path = scratch(self.spark, label)
            df.write.parquet(path)
            return self.spark.read.parquet(path)

        avg = total / n
        asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(X.bm25_tokens(F.col("query")))).alias("term"))
        asked = staged(asked, "asked-words")
        words = asked.count()
        df = self._read(manifest, "df", ("rows", "buried")).join(small(asked.select("term").distinct(), words), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = asked.join(small(df, words), "term").select("query_id", "term", idf.alias("idf"), _bucket(F.col("term")).alias("bucket"), F.xxhash64("term").alias("number"))
        weighed = staged(weighed, "asked")
        buckets = [r[0] for r in weighed.select("bucket").distinct().collect()]
        if not buckets:
            return empty, Pruning(0, 0)
        blocks = self._read(manifest, "blocks", ("rows",)).filter(F.col("bucket").isin(buckets))
        bound = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_len") / avg))
        bounds = small(weighed, words).join(blocks.select("bucket", "term", "slice", "max_tf", "min_len"), ["bucket", "term"])
        bounds = staged(bounds.groupBy("query_id", "slice").agg(F.sum(bound).alias("bound")), "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            """query_id, doc_id, score of the live documents in chosen slices (query_id, slice), those that can be among the k best."""
            out = None
            passes = max(1, -(-words // BROADCAST_ROWS))
            for p in range(passes):
                part = lambda rows: rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
                found = self._scores(part(weighed), part(chosen), self._live(manifest, blocks), k, k1, b, avg)
                out = found if out is None else out.unionByName(found)
            return out

        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
        # with tombstones a slice may have no hit left, so a few more are read
        more = k if not any(s["kind"] == "buried" for s in manifest["segments"]) else 2 * k + 8
        seeds = staged(bounds.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= more).select("query_id", "slice"), "seeds")
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        first = staged(scored(seeds).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k), "first")
        least = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(least, "query_id", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - _SLACK)
        rest = staged(rest.join(seeds, ["query_id", "slice"], "left_anti").select("query_id", "slice"), "rest")
        both = first.select("query_id", "doc_id", "score").unionByName(scored(rest))
        out = both.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        return out.select("query_id", "doc_id", "score", "rank"), Pruning(bounds.count(), seeds.count() + rest.count())

    def _scores(self, weighed: DataFrame, chosen: DataFrame, blocks: DataFrame, k: int, k1: float, b: float, avg: float) -> DataFrame:
        """Scores of chosen slices. The terms of this pass's questions (BROADCAST_ROWS at most) are sent to all tasks; the blocks of a slice meet in one."""
        table = weighed.select("query_id", "number", "idf").toArrow().combine_chunks()
        questions = table.column("query_id").combine_chunks().dictionary_encode()
        order = np.argsort(table.column("number").to_numpy(), kind="stable")
        asked, query = questions.dictionary, questions.indices.to_numpy()[order]
        term, idf = (table.column(c).to_numpy()[order] for c in ("number", "idf"))
        sent = self.spark.sparkContext.broadcast((asked, query, term, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, query, term, idf = sent.value
            least = np.zeros((len(asked), k))  # the k best scores of each question so far
            for batch in batches:
                for r in range(batch.num_rows):
                    wanted = np.unique(pc.index_in(batch.column(0)[r].values, asked).to_numpy())
                    for lo in range(0, len(wanted), 256):
                        some = wanted[lo : lo + 256]
                        ids, scores = _slice_scores(batch.column(1)[r].values, query, term, idf, some, k1, b, avg)
                        keep = _best(scores, np.zeros(scores.shape, bool), ids, k) & (scores > 0) & (scores >= least[some].min(1, keepdims=True))
                        least[some] = np.partition(np.concatenate([least[some], scores], 1), -k, 1)[:, -k:]
                        x, y = np.nonzero(keep)
                        if len(x):
                            yield pa.RecordBatch.from_arrays([asked.take(pa.array(some[x])), ids.take(pa.array(y)), pa.array(scores[x, y])], ["query_id", "doc_id", "score"])

        wanted = chosen.groupBy("slice").agg(F.collect_list("query_id").alias("wanted"))
        own = blocks.join(small(weighed.select("bucket", "term", "number").distinct()), ["bucket", "term"])
        own = own.join(small(wanted.select("slice")), "slice", "left_semi")
        rows = own.groupBy("slice").agg(F.collect_list(F.struct("number", "postings")).alias("blocks")).join(wanted, "slice").select("wanted", "blocks")
        kinds = chosen.schema["query_id"].dataType.simpleString(), blocks.schema["postings"].dataType.elementType["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")

    def compact(self) -> int:
        """One segment of the live documents, made of their blocks: no text is read again. Slices that are less than half full are joined, the others stay where they are."""
        base, manifest = self.manifests.load()
        if len(manifest["segments"]) < 2:
            return base
        stored = self._read(manifest, "blocks", ("rows",)).drop("bucket")

        def whole(blocks: DataFrame) -> DataFrame:
            found = self._live(manifest, blocks)
            most, least = F.array_max("postings.tf"), F.array_min("postings.len")
            return found.withColumn("max_tf", most).withColumn("min_len", least)

        path = f"data/{uuid.uuid4().hex}"
        sizes = self._live(manifest, self._read(manifest, "blocks", ("rows",)).filter(F.col("bucket") == DOCUMENTS))
        sizes = self._write(sizes.select("slice", F.size("postings").cast("long").alias("n")).filter(F.col("n") * 2 < self.slice_docs), path, "joined")
        slices, n = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        blocks = whole(stored)
        if slices > 1:
            to = F.lit(base + 1 << 44) + F.pmod(F.xxhash64("slice"), F.lit(-(-n // self.slice_docs)))
            few = small(sizes.select("slice"), slices)
            joined = whole(stored.join(few, "slice", "left_semi")).groupBy("term", to.alias("slice"))
            joined = joined.agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.flatten(F.collect_list("postings")).alias("postings"))
            blocks = whole(stored.join(few, "slice", "left_anti")).unionByName(joined)
        segment = self._segment(path, blocks, base + 1)
        return self.manifests.commit(base, {"segments": [segment] if segment["n_docs"] else []})
