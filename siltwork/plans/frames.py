"""The driver tables in the shapes the operators expect.

Candidates are documents with an id, author, node and age made from ``doc_id``; a candidate's
vector is the embedding of the same number, its verdict comes from ``labels`` and ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_SECONDS = 1789171200
DAY = 86400
CHANNELS = ("whatsapp", "inbound", "linkedin", "reddit", "substack", "github", "hackernews", "other")
SIGNALS = (("is_building", 7), ("thesis_fit", 11), ("founder_quality", 13), ("timing", 17), ("reachable", 19), ("too_late", 23))

#: The same frames for the oracles.
CANDIDATES_SQL = """
c AS (
    SELECT doc_id, sha256('doc://' || doc_id) AS id, source, text, substr(text, 1, 60) AS title,
           'u' || (doc_id % 97) AS author, 'n' || (doc_id % 13) AS node,
           list_extract(['whatsapp','inbound','linkedin','reddit','substack','github','hackernews','other'], CAST(doc_id % 8 AS INTEGER) + 1) AS channel,
           1789171200 - (doc_id * 37 % 720) * 86400 AS posted_s
    FROM documents
)"""
VERDICTS_SQL = """
v AS (
    SELECT doc_id, (doc_id * 7 % 101) / 100.0::DOUBLE AS is_building, (doc_id * 11 % 101) / 100.0::DOUBLE AS thesis_fit,
           (doc_id * 13 % 101) / 100.0::DOUBLE AS founder_quality, (doc_id * 17 % 101) / 100.0::DOUBLE AS timing,
           (doc_id * 19 % 101) / 100.0::DOUBLE AS reachable, (doc_id * 23 % 101) / 100.0::DOUBLE AS too_late
    FROM documents
)"""
SIMILARITY_SQL = """
t AS (SELECT vec_id AS tid, CAST(embedding AS DOUBLE[]) AS tv FROM embeddings WHERE vec_id < 10),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings),
s AS (
    SELECT vec_id AS doc_id, max(round(list_cosine_similarity(ev, tv), 6)) AS similarity,
           min_by(tid, (-round(list_cosine_similarity(ev, tv), 6), tid)) // 2 AS thesis
    FROM e, t GROUP BY vec_id
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a task of heavy work on texts.
ROWS_IN_TASK = 4_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over as many tasks as a shuffle has, and more if a task would get too many.

    A row group is read by one task, however many rows it holds, so heavy work on their texts
    must not stay with it. Counting reads no column.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-rows.count() // ROWS_IN_TASK)), key)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.sha2(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")), 256).alias("id"),
        "source",
        "text",
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("u"), F.col("doc_id") % 97).alias("author"),
        F.concat(F.lit("n"), F.col("doc_id") % 13).alias("node"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("doc_id") % 8 + 1).cast("int")).alias("channel"),
        (F.lit(NOW_SECONDS) - F.col("doc_id") * 37 % 720 * DAY).alias("posted_s"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each signal and a quote: every third one is not in the text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[(F.col("doc_id") * p % 101 / F.lit(100.0)).alias(name) for name, p in SIGNALS])


def thesis_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten phrasings of five theses."""
    return table(spark, sf_dir, "embeddings").where("vec_id < 10").select(F.col("vec_id").alias("phrasing"), F.expr("vec_id div 2").alias("thesis"), F.col("embedding").alias("vector"))
