"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its decision takes effect
in what it returns. ``run`` writes each result as Parquet under spark.checkpoint.dir and
reads it back as the next one's documents, so a stage never depends on the lineage of the
stages before it. The classifier and the benchmark filter decide in place; the two dedup
stages write their decisions (narrow rows) and join them to the texts.

Edge cases: those of the operators; repeated rows leave one row in the exact stage; rows
that share an id and differ in text stay together in the near stage if one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultscope.llm import contamination, exact_dedup, packing, quality, simhash
from faultscope.llm.common import ascii_lower, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id; of repeated rows one."""
    decided = stored(exact_dedup.exact_dedup(docs), "exact-decisions").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept", F.expr("doc_id <=> keep_id").alias("own"))
    sha = "_".join(["sha", *docs.columns])  # a name that no column has
    keyed = docs.withColumn(sha, exact_dedup.sha256(ascii_lower(F.col("text"))))

    def same(other: DataFrame):
        return keyed["doc_id"].eqNullSafe(other["id"]) & (keyed[sha] == other["sha"])

    gone = decided.where("NOT kept AND NOT own")
    again = decided.where("NOT kept AND own").select("id", "sha").distinct()
    if again.isEmpty():
        return keyed.join(gone, same(gone), "left_anti").drop(sha)
    either = gone.select("id", "sha").union(again)
    rows = keyed.join(again, same(again), "left_semi").dropDuplicates(["doc_id", sha])
    return keyed.join(either, same(either), "left_anti").unionByName(rows).drop(sha)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id."""
    decided = stored(simhash.near_dedup(docs).select(F.col("doc_id").alias("id"), F.expr("doc_id <=> component_id").alias("kept")), "near-decisions")
    kept = decided.where("kept").select(F.col("id").alias("kept_id"))
    gone = decided.where("NOT kept").join(kept, F.expr("id <=> kept_id"), "left_anti")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
