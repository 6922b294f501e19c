"""Key-value state as tables: upserts, deletes by index, recency, caches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_last(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key; `position` is where the key first stood."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.min(seq).alias("position"))
    return last.select(key, "r.*", "position")


def merge_entries(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with new entries put over old ones of the same key."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(store: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """(what is left, one row with the number removed) of deleting by an indexed column."""
    hit = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
    return store.filter(~hit), store.agg(F.count_if(hit).alias("removed"))


def replace_source(store: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """The store without rows of any source in `new`, and `new`; a shorter version leaves no stale rows."""
    return store.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def last_n(rows: DataFrame, by: str, seq: str, n: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))
    return rows.withColumn("_n", back).filter(F.col("_n") <= n).drop("_n")


def lru_survivors(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """Keys in a cache of `capacity` after a log of accesses, each miss being followed by a set: the most recently used ones."""
    used = log.groupBy(key).agg(F.max(seq).alias("last_used"))
    return used.orderBy(F.desc("last_used")).limit(capacity)


def cached_parts(inputs: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs that the cache has, inputs that it lacks)."""
    keys = cache.select(*key).distinct()
    return inputs.join(keys, key, "left_semi"), inputs.join(keys, key, "left_anti")


def source_hashes(store: DataFrame) -> DataFrame:
    """(source, source_hash): the distinct non-empty hashes of each source, a row each, so a large source is no single row."""
    return store.filter(F.col("source_hash").isNotNull() & (F.col("source_hash") != "")).select("source", "source_hash").distinct()


def trim_log(messages: DataFrame, by: str, seq: str, keep: int = 50) -> DataFrame:
    """What is persisted of conversations: those with messages, the last `keep` of each."""
    return last_n(messages.filter(F.length(F.coalesce("text", F.lit(""))) > 0), by, seq, keep)


def step_durations(steps: DataFrame) -> DataFrame:
    return steps.withColumn("duration_ms", F.col("finished_ms") - F.col("started_ms"))


def migrate_legacy(raw: DataFrame, model_id: str, json_col: str = "json") -> DataFrame:
    """Entries of a legacy JSON dump: vectors as arrays or as objects of positions; rows without id, text or a finite vector drop out."""
    entry = "struct<id:string,text:string,source:string,embedding:string>"
    rows = raw.select(F.explode(F.from_json(F.col(json_col), f"array<{entry}>")).alias("e")).select("e.*")
    listed = F.from_json("embedding", "array<double>")
    entries = F.transform(F.map_entries(F.from_json("embedding", "map<string,double>")), lambda e: F.struct(e["key"].try_cast("int").alias("at"), e["value"].alias("value")))
    keyed = F.transform(F.array_sort(entries), lambda e: e["value"])
    vec = F.when(F.col("embedding").startswith("["), listed).otherwise(keyed)
    rows = rows.select("id", "text", F.coalesce("source", F.lit("")).alias("source"), vec.alias("embedding"), F.lit(model_id).alias("model_id"))
    from tesserae.functions.vectors import is_valid

    return rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & is_valid(F.col("embedding")))
