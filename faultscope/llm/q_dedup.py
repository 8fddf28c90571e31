"""Queries of the dedup operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, simhash, substring
from .common import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(len(w) - 19)) AS start, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS win FROM d WHERE len(w) >= 20
), g AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1 AS again FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM g WHERE again
), l AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d
), k AS (
  SELECT l.doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.place = l.place GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
