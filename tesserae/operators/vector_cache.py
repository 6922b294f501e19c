"""Embeddings kept by content: a store that tasks write back to, so that a text is sent to a model once.

Entries are found by model and digest of the text. A bitmap of fixed size (a Bloom filter) is kept with
every commit; texts that it rules out go to the model at once, only the others are joined with the store.
New vectors are written by the tasks that asked for them and one commit adds them; if another run commits
first, this one takes the new version and commits again, as equal entries are equal by content.

Edge cases: null texts are empty ones; copies of a text are asked once; a model that fails leaves the store
as it was; entries of other models count for nothing; an empty input makes no call and no commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.snapshots import Conflict, Folder, Manifests

#: Bits of the filter (a megabyte) and bits of an entry. The size is fixed: with very many entries it rules out less, and the join does more.
BITS, HASHES = 1 << 23, 3
_WORD = 64


class VectorCache:
    def __init__(self, spark: SparkSession, root: str, model: str, call: Callable[[list[str]], list[list[float]]], batch: int = 64):
        self.spark, self.model, self.call, self.batch = spark, model, call, batch
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def _key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}:"), F.coalesce(text, F.lit(""))), 256)

    @staticmethod
    def _bits(key: Column) -> Column:
        """Places of an entry's bits."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(k), key), F.lit(BITS)) for k in range(HASHES)])

    def _table(self, manifest: dict, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder.root}/{s['path']}/{name}" for s in manifest["segments"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self, version: int | None = None) -> DataFrame:
        """(key, vector); a key that two runs wrote at once comes once."""
        rows = self._table(self.manifests.load(version)[1], "vectors", "key string, vector array<double>")
        return rows.groupBy("key").agg(F.first("vector").alias("vector"))

    def _bitmap(self, manifest: dict) -> DataFrame:
        """One row: the bitmap as an array of BITS / 64 longs."""
        places = self.spark.range(BITS // _WORD).select(F.col("id").cast("int").alias("word"))
        words = self._table(manifest, "filter", "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        full = places.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("_bitmap"))

    def missing(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """(key, text) of the different texts that the store does not have."""
        version, manifest = self.manifests.load()
        once = texts.select(self._key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
        if not version:
            return once
        bitmap = self._bitmap(manifest)
        one = lambda b: F.get("_bitmap", (b / _WORD).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (b % _WORD).cast("int"))) != 0
        seen = once.crossJoin(F.broadcast(bitmap)).withColumn("_may", F.forall(self._bits(F.col("key")), one)).drop("_bitmap")  # one row of a megabyte
        may = seen.filter("_may").join(self._table(manifest, "vectors", "key string, vector array<double>").select("key"), "key", "left_anti")
        return seen.filter("NOT _may").unionByName(may).select("key", "text")

    def fill(self, texts: DataFrame, text_col: str = "text") -> int:
        """Asks the model for the texts that the store does not have, keeps what it says, and gives their number."""
        call, size = self.call, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, len(b), size):
                    part = b.slice(lo, size)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(call(part.column(1).to_pylist()), pa.list_(pa.float64()))], ["key", "vector"])

        path = f"data/{uuid.uuid4().hex}"
        where = f"{self.folder.root}/{path}"
        self.missing(texts, text_col).mapInArrow(run, "key string, vector array<double>").write.parquet(f"{where}/vectors")
        new = self.spark.read.schema("key string, vector array<double>").parquet(f"{where}/vectors")
        n = new.count()
        if not n:
            self.folder.remove(path)
            return 0
        places = new.select(F.explode(self._bits(F.col("key"))).alias("b"))
        word = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % _WORD).cast("int"))
        places.groupBy((F.col("b") / _WORD).cast("int").alias("word")).agg(F.bit_or(word).alias("bits")).write.parquet(f"{where}/filter")
        while True:
            base, manifest = self.manifests.load()
            try:
                self.manifests.commit(base, {"segments": [*manifest["segments"], {"path": path, "n": n}]})
                return n
            except Conflict:
                continue

    def embed(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows with `embedding`, new texts asked and kept before."""
        self.fill(texts, text_col)
        rows = texts.withColumn("_key", self._key(F.col(text_col)))
        kept = self.entries().select(F.col("key").alias("_key"), F.col("vector").alias("embedding"))
        return rows.join(kept, "_key", "left").drop("_key")
