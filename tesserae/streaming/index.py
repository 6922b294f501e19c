"""Keeping an index up to date from a stream of chunks (an addition: the original indexes in one go)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.retrieval import postings
from tesserae.operators.state import upsert_last


def read_chunks(spark: SparkSession, path: str, schema: str = "doc_id long, source string, text string, seq long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def maintain_postings(chunks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch's last versions of documents as postings, written to a folder of their own batch number.

    A batch that is run again overwrites its own folder, so a failure never doubles rows. `current`
    keeps the newest batch of each document.
    """

    def put(batch: DataFrame, number: int) -> None:
        last = upsert_last(batch, "doc_id", "seq").drop("position")
        rows = postings(last).join(last.select("doc_id", "seq"), "doc_id")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """(doc_id, term, tf) of the newest version of every document."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    return rows.join(newest, ["doc_id", "seq"]).select("doc_id", "term", "tf")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by type in tumbling windows of a stream or a table, later ones than the watermark being dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
