"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs: language identification drops
documents without an identified language, near-deduplication keeps one document of each group at a
similarity of 0.8 or more, suffix-array deduplication cuts out repeated passages, decontamination drops
documents that hold a benchmark window, and packing gives the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, langid, minhash, packing, suffixes

#: Up to so many removed ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of several rows with its doc_id, one."""
    common.prepare(spark)
    found = common.staged(minhash.near_duplicates(docs, percent=80, bands=32, rows=4).filter("doc_id IS NOT NULL AND n_shingles > 0"), "near")
    gone = common.staged(found.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = common.staged(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")), "again")
    if again.isEmpty():
        return left
    once = left.join(again, left["doc_id"] == again["_again"], "left_anti")
    return once.unionByName(left.join(again, left["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"]))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return suffixes.remove_repeats(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return decontaminate.remove_contaminated(docs, common.documents(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op3_best_fit_packing(spark, sf_dir, docs)


STAGES = [
    ("language_identification", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and hashing have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
