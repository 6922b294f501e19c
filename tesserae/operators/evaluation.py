"""Scoring of answered questions: per-question metrics, summaries, a report, and ranking metrics on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The score above which a chunk counts as relevant, and the recall that passes.
RELEVANT_ABOVE, PASS_RECALL = 0.3, 0.5


def recall(relevant: Column, wanted: Column) -> Column:
    return F.when(wanted == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), relevant / F.when(wanted == 0, 1).otherwise(wanted)))


def row_metrics(results: DataFrame, scores: str = "scores") -> DataFrame:
    """Adds routing_correct, relevant_chunks, recall_at_k and passed."""
    rows = results.withColumn("relevant_chunks", F.size(F.filter(scores, lambda s: s > RELEVANT_ABOVE)))
    rows = rows.withColumn("routing_correct", F.coalesce(F.col("actual_source") == F.col("expected_source"), F.lit(False)))
    rows = rows.withColumn("recall_at_k", recall(F.col("relevant_chunks"), F.col("min_relevant_chunks")))
    return rows.withColumn("passed", F.col("error").isNull() & F.col("routing_correct") & (F.col("recall_at_k") >= PASS_RECALL))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, passed, failed, routing_accuracy, avg_recall, avg_latency_ms; zeros without rows."""
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(
        n.alias("total"),
        F.count_if("passed").alias("passed"),
        (n - F.count_if("passed")).alias("failed"),
        F.round(mean(F.col("routing_correct").cast("int")), 6).alias("routing_accuracy"),
        F.round(mean("recall_at_k"), 6).alias("avg_recall"),
        F.round(mean("latency_ms"), 3).alias("avg_latency_ms"),
    )


def report(rows: DataFrame, title: str) -> DataFrame:
    """(seq, line): the report's lines in order."""
    pct = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))
    s = summary(rows).select(
        F.posexplode(
            F.array(
                F.lit(f"# {title}"),
                F.format_string("**Total Questions:** %d", "total"),
                F.format_string("**Passed:** %d / %d (%.1f%%)", "passed", "total", F.round(F.col("passed") / F.greatest("total", F.lit(1)) * 100, 1)),
                F.concat(F.lit("**Routing Accuracy:** "), pct("routing_accuracy")),
                F.concat(F.lit("**Avg Recall@K:** "), pct("avg_recall")),
                F.format_string("**Avg Latency:** %.0fms", "avg_latency_ms"),
            )
        ).alias("n", "line")
    )
    head = s.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("key"), "n").alias("seq"), "line")
    c = summary(rows, ["category"]).select(F.struct(F.lit(1).alias("part"), F.col("category").alias("key"), F.lit(0).alias("n")).alias("seq"), F.concat(F.format_string("- **%s**: %d/%d passed, routing ", "category", "passed", "total"), pct("routing_accuracy")).alias("line"))
    status = F.when(F.col("error").isNotNull(), "❌ ERROR").when(F.col("passed"), "✅ PASS").otherwise("❌ FAIL")
    q = rows.select(F.struct(F.lit(2).alias("part"), F.col("question_id").alias("key"), F.lit(0).alias("n")).alias("seq"), F.concat(F.lit("### "), "question_id", F.lit(" "), status, F.lit(" recall "), pct("recall_at_k")).alias("line"))
    return head.unionByName(c).unionByName(q)


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """An addition: per query hits@k, precision@k, reciprocal rank and nDCG@k of (query_id, id, rank) against relevant (query_id, id)."""
    marked = hits.filter(F.col("rank") <= k).join(relevant.withColumn("_r", F.lit(1)), ["query_id", id_col], "left")
    gain = F.when(F.col("_r") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    got = marked.groupBy("query_id").agg(F.count("_r").alias("hits"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("_r") == 1, F.col("rank"))).alias("first"))
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return got.join(total, "query_id").select("query_id", "hits", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def first_relevant(hits: DataFrame, relevant: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.join(relevant, ["query_id", id_col]).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
