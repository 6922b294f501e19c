"""Relational glue of retrieval-augmented answering: union, first-wins, rerank, grading, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text as X
from tesserae.operators.retrieval import small
from tesserae.sources.tables import scratch

RERANK_K = 4
BLOCK, RULE = "\n\n---\n\n", "\n\n============\n\n"


def dedup_first(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each key by `seq`."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(seq))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def fanout_union(primary: DataFrame, secondary: DataFrame, key: list[str], seq: str = "rank") -> DataFrame:
    """Primary hits, then secondary ones not among them, numbered on in `seq`."""
    both = primary.withColumn("_side", F.lit(0)).unionByName(secondary.withColumn("_side", F.lit(1)))
    once = dedup_first(both.withColumn("_at", F.struct("_side", seq)), key, "_at")
    order = Window.partitionBy(*key[:-1]).orderBy("_side", seq) if key[:-1] else Window.orderBy("_side", seq)
    return once.withColumn(seq, F.row_number().over(order)).drop("_side", "_at")


def rerank_overlap(hits: DataFrame, by: str, hypothesis: str, content: str, seq: str, k: int = RERANK_K, fallback: Column | None = None) -> DataFrame:
    """The k hits whose text covers most of the hypothesis; where nothing overlaps, the hit's own score stands in."""
    overlap = X.token_overlap(F.col(hypothesis), F.col(content))
    s = F.when(overlap > 0, overlap).otherwise(F.coalesce(fallback if fallback is not None else F.lit(0.0), F.lit(0.0)))
    scored = hits.withColumn("overlap", F.round(s, 6))
    order = Window.partitionBy(by).orderBy(F.desc("overlap"), seq)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def overlap_scores(docs: DataFrame, items: DataFrame, by: str, id_col: str, text_col: str, hypothesis: str) -> DataFrame:
    """(by, id, overlap) of every item with every document that holds some of its tokens: the same share as `text.token_overlap`.

    Tokens are taken once on each side and joined, so the work follows the tokens that both have. The items' tokens
    are broadcast where they are few, so that a word of every document does not bring all of them into one task.
    """
    asked = items.select(by, X.overlap_tokens(F.col(hypothesis)).alias("_h"))
    terms = asked.select(by, F.size("_h").alias("_of"), F.explode("_h").alias("_token")).groupBy(by, "_of", "_token").agg(F.count(F.lit(1)).alias("_n"))
    held = docs.select(id_col, F.explode(F.array_distinct(X.overlap_tokens(F.col(text_col)))).alias("_token"))
    found = held.join(small(terms), "_token").groupBy(by, id_col).agg(F.sum("_n").alias("_n"), F.max("_of").alias("_of"))
    return found.select(by, id_col, F.round(F.col("_n") / F.col("_of"), 6).alias("overlap"))


def rerank_corpus(docs: DataFrame, items: DataFrame, by: str, id_col: str, text_col: str, hypothesis: str, k: int = RERANK_K) -> DataFrame:
    """For every item the k documents of a whole table that cover most of its hypothesis, of those that cover any.

    Tokens are taken rarest first. The documents that have an item's rarest tokens, enough of them to hold k, are
    counted in full, which gives a number of hits that its k-th document has at least. The most common tokens whose
    occurrences in the hypothesis are fewer together cannot bring a document in, so candidates come from the
    others only, and each is counted once against the whole hypothesis. Nothing is joined on a word that every
    document has, unless the k-th document's share consists of such words.
    """
    spark = docs.sparkSession

    def staged(df: DataFrame, label: str) -> DataFrame:
        path = scratch(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    asked = items.select(F.col(by).alias("_by"), X.overlap_tokens(F.col(hypothesis)).alias("_h")).filter(F.size("_h") > 0)
    terms = asked.select("_by", F.size("_h").alias("_of"), F.explode("_h").alias("_token")).groupBy("_by", "_of", "_token").agg(F.count(F.lit(1)).alias("_n"))
    terms = staged(terms, "rerank-terms")
    held = staged(docs.select(F.col(id_col).alias("_id"), F.array_distinct(X.overlap_tokens(F.col(text_col))).alias("_d")), "rerank-tokens")
    posted = held.select("_id", F.explode("_d").alias("_token"))
    df = posted.join(terms.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))
    known = terms.join(staged(df, "rerank-df"), "_token")  # tokens that no document has bring nothing
    # windows over the tokens of one item, few however many documents there are
    rare = Window.partitionBy("_by").orderBy("_df", "_token")
    known = known.withColumn("_before", F.coalesce(F.sum("_df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = staged(known.withColumn("_rest", F.sum("_n").over(rare.rowsBetween(0, Window.unboundedFollowing))), "rerank-known")
    hypotheses = staged(terms.groupBy("_by", "_of").agg(F.collect_list("_token").alias("_h"), F.filter(F.collect_list(F.struct("_token", "_n")), lambda t: t["_n"] > 1).alias("_more")), "rerank-items")

    def counted(chosen: DataFrame) -> DataFrame:
        """(_by, _id, _hits, _of) of the documents that have any of the chosen tokens, all tokens counted."""
        pairs = posted.join(chosen.select("_by", "_token"), "_token").select("_by", "_id").distinct()
        both = F.array_intersect("_h", "_d")
        again = F.aggregate("_more", F.lit(0).cast("long"), lambda n, t: n + F.when(F.array_contains("_d", t["_token"]), t["_n"] - 1).otherwise(0))
        return pairs.join(hypotheses, "_by").join(held, "_id").select("_by", "_id", (F.size(both) + again).alias("_hits"), "_of")

    # a document may have several of the rarest tokens, so those of 4k postings are taken; with fewer than k documents among them nothing is ruled out
    seeds = known.filter(F.col("_before") < k * F.lit(4))
    best = Window.partitionBy("_by").orderBy(F.desc("_hits"), "_id")
    first = staged(counted(seeds), "rerank-first")
    least = first.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == k).select("_by", F.col("_hits").alias("_least"))
    rest = known.join(least, "_by", "left").filter((F.col("_before") >= k * F.lit(4)) & (F.col("_rest") >= F.coalesce("_least", F.lit(0))))
    scored = first.unionByName(counted(rest)).distinct()
    out = scored.withColumn("overlap", F.round(F.col("_hits") / F.col("_of"), 6))
    order = Window.partitionBy("_by").orderBy(F.desc("overlap"), "_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("_by").alias(by), F.col("_id").alias(id_col), "overlap", "rank")


def grade_filter(hits: DataFrame, by: str, outcome: Column, seq: str, first: int | None = None) -> DataFrame:
    """Hits graded relevant or keep-on-error, in order, the first n of them."""
    kept = hits.filter(outcome.isin("relevant", "keep-on-error"))
    if first is None:
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(seq))).filter(F.col("_n") <= first).drop("_n")


def judge(rows: DataFrame, question: str, content: str, ask: Callable[[str, str], str], limit: int = 1500) -> DataFrame:
    """Adds `outcome`: what an injected callable answers about (question, first characters of the text); its failures keep the row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for q, c in zip(df[question], df[content]):
                try:
                    out.append("relevant" if ask(q, (c or "")[:limit]).strip().lower() == "yes" else "irrelevant")
                except Exception:  # noqa: BLE001  any failure of the model keeps the document
                    out.append("keep-on-error")
            yield df.assign(outcome=out)

    schema = T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())])
    return rows.mapInPandas(run, schema)


def prompt_context(docs: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, context): `[source p.N]` and the text of each document, ruled off, in order."""
    head = F.concat(F.lit("["), "source", F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise(""), F.lit("]\n"), "content")
    lists = docs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), head.alias("t")))).alias("l"))
    return lists.select(by, F.concat(F.lit("DOCUMENTS:\n"), F.array_join(F.transform("l", lambda x: x["t"]), BLOCK)).alias("context"))


def join_blocks(*blocks: Column) -> Column:
    """The non-null blocks of a prompt, ruled off."""
    return F.array_join(F.array_compact(F.array(*blocks)), RULE)


def citations(hits: DataFrame) -> DataFrame:
    return hits.withColumn("excerpt", X.citation(F.col("heading"), F.col("content")))
