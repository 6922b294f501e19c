"""Replaying a least-recently-used cache over a log of gets and sets, in parallel and exactly.

Whether a get hits depends on everything before it, since a hit refreshes its key and a miss does not. The
log is cut into segments of time that are replayed at once, each from what the cache is believed to hold
when it begins; then every segment is told what the one before it ended with, and those that believed
something else are replayed again, until nothing changes. The first segment is right from the start, and a
segment that is told right is right, so this ends with the sequential answer after as many rounds as there
are segments at most. A segment in which enough keys are used forgets where it began, so few rounds do.

Beliefs are a small table, `capacity` keys a segment; no segment's rows or states come to the driver.

Edge cases: rows of one `seq` go by key, then sets before gets; null keys are a key; other operations than
get and set do nothing and have no result; an empty log gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.tables import scratch

SEGMENT_ROWS = 200_000


class Cache:
    """Keys in order of use, the most recent last."""

    def __init__(self, capacity: int, keys: list | None = None):
        self.capacity, self.keys = capacity, OrderedDict.fromkeys(keys or [])

    def get(self, key) -> bool:
        if key not in self.keys:
            return False
        self.keys.move_to_end(key)
        return True

    def set(self, key) -> None:
        self.keys[key] = None
        self.keys.move_to_end(key)
        if len(self.keys) > self.capacity:
            self.keys.popitem(last=False)


def _staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replay(log: DataFrame, key: str, seq: str, op: str, capacity: int, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(the log's key, seq and op with `hit`, null for sets; the keys held at the end in order of use; rounds).

    Segments are ranges of `seq`, so a `seq` of very many rows makes one large segment; its rows stream through its task.
    """
    spark = log.sparkSession
    rows = log.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(op).alias("op")).filter(F.col("op").isin("get", "set"))
    parts = max(1, -(-rows.count() // segment_rows))
    log = _staged(spark, rows.repartitionByRange(parts, "seq").withColumn("segment", F.spark_partition_id()), "lru-log")
    kind, order = rows.schema["key"].dataType.simpleString(), rows.schema["seq"].dataType.simpleString()
    numbers = log.select("segment").distinct()
    beliefs = _staged(spark, numbers.select("segment", F.array().cast(f"array<{kind}>").alias("held")), "lru-beliefs")
    schema = f"segment int, key {kind}, seq {order}, op string, hit boolean, held array<{kind}>"
    names = ["segment", "key", "seq", "op", "hit", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with results, then for each segment one row without op that says what the cache holds."""
        now = cache = None
        for b in batches:
            fields = [b.schema.field(n).type for n in ("segment", "key", "seq", "op")]
            kinds = [*fields, pa.bool_(), pa.list_(fields[1])]
            out: list[tuple] = []
            for seg, first, held, k, s, o in zip(*(b.column(n).to_pylist() for n in ("segment", "first", "held", "key", "seq", "op"))):
                if seg != now:
                    if cache is not None:
                        out.append((now, None, None, None, None, list(cache.keys)))
                    now, cache = seg, Cache(capacity)
                if first:
                    cache = Cache(capacity, held)
                elif o == "set":
                    cache.set(k)
                    out.append((seg, k, s, o, None, None))
                else:
                    out.append((seg, k, s, o, cache.get(k), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if cache is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, None, None, None, None, list(cache.keys)), kinds)], names)

    found, rounds, todo = None, 0, beliefs
    while True:
        rounds += 1
        told = todo.select("segment", F.lit(1).alias("first"), "held", F.lit(None).cast(kind).alias("key"), F.lit(None).cast(order).alias("seq"), F.lit(None).cast("string").alias("op"))
        wanted = log.join(todo.select("segment"), "segment", "left_semi").select("segment", F.lit(0).alias("first"), F.lit(None).cast(f"array<{kind}>").alias("held"), "key", "seq", "op")
        # sets come before gets of the same key and time
        dealt = told.unionByName(wanted).repartition("segment").sortWithinPartitions("segment", F.desc("first"), "seq", "key", F.desc("op"))
        new = _staged(spark, dealt.mapInArrow(run, schema), "lru-replayed")
        found = new if found is None else found.join(new.select("segment").distinct(), "segment", "left_anti").unionByName(new)
        ends = _staged(spark, found.filter("op IS NULL").select("segment", "held"), "lru-ends")
        found = _staged(spark, found, "lru-found") if rounds > 1 else found
        # what each segment should have begun with: the end of the last one before it that there is
        pairs = numbers.select("segment").withColumn("before", F.expr("lag(segment) OVER (ORDER BY segment)"))  # a row for each segment
        right = pairs.join(ends.withColumnRenamed("segment", "before"), "before").select("segment", F.col("held").alias("right"))
        changed = beliefs.join(right, "segment").filter(~F.col("held").eqNullSafe(F.col("right")))
        todo = _staged(spark, changed.select("segment", F.col("right").alias("held")), "lru-todo")
        if todo.isEmpty():
            break
        beliefs = _staged(spark, beliefs.join(todo.select("segment"), "segment", "left_anti").unionByName(todo), "lru-beliefs")
    results = found.filter("op IS NOT NULL").select(F.col("key").alias(key), F.col("seq").alias(seq), F.col("op").alias(op), "hit")
    last = ends.orderBy(F.desc("segment")).limit(1)
    held = last.select(F.posexplode("held").alias("position", key))
    return results, held, rounds
