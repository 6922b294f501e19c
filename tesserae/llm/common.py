"""What the operators of this subpackage share: staging, batching and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.shipping import ship

#: Rows of an Arrow batch. Texts may be long, and two workers share an executor.
BATCH_ROWS = 1000
#: Spark's setting that removes the shuffle files of a statement once it has ended; else they stay until the driver collects its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors and keeps Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables, spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation. What was shuffled for it goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a staged table that nothing will read again."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out of all learning."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def bounded_sample(df: DataFrame, key: str, bound: int, by: str | None = None, total: int | None = None) -> DataFrame:
    """The rows of about `bound` ids (of each value of `by`, and about `total` ids of all), chosen by a hash of the id; all where there are no more.

    Ids are counted, not rows, and of every value at least one id is chosen. A row for each value of `by` comes to the driver.
    """
    cells = 1 << 20
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(cells))
    if by is None:
        n = df.select(key).distinct().count()
        return df if n <= bound else df.filter(cell < int(cells * bound / n))
    counts = df.select(F.col(by).alias("_value"), key).distinct().groupBy("_value").agg(F.count(F.lit(1)).alias("_n"), F.min(cell).alias("_least")).collect()
    if total is not None and counts:
        bound = min(bound, max(1, total // len(counts)))
    shares = [(r["_value"], max(int(cells * min(1.0, bound / r["_n"])), r["_least"] + 1)) for r in counts]
    schema = T.StructType([T.StructField("_value", df.schema[by].dataType), T.StructField("_share", T.LongType())])
    few = df.sparkSession.createDataFrame(shares, schema)
    return df.join(F.broadcast(few), df[by] == few["_value"]).filter(cell < F.col("_share")).drop("_value", "_share")


def within_bytes(rows: DataFrame, key: str, text_col: str, total: int) -> DataFrame:
    """Rows of a sample whose texts have about `total` bytes at most, thinned by a hash of the id; rows above a sixteenth of that are left out."""
    size = F.octet_length(F.col(text_col))
    fit = rows.filter(size <= total // 16)
    n = fit.agg(F.sum(size.cast("long"))).first()[0] or 0
    return fit if n <= total else fit.filter(F.pmod(F.xxhash64(F.lit("thin"), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * total / n))


def clear_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y): the ids outside the held-out fold whose labels are 0 or 1 and agree; rows without an id, and ids with both labels, teach nothing."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marked = marked.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id") != 2))
    return marked.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).filter("_y = _top").drop("_top")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each of the keys, with the least of its texts `_t`, so that copies of an id do not add to a sample."""
    return rows.groupBy(*keys).agg(F.min("_t").alias("_t"))
