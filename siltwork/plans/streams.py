"""Streams over the driver tables, each run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.ranking import ensure_checkpoint_dir, rank_within
from siltwork.plans.frames import table
from siltwork.plans.graph import entity_resolution, mentions
from siltwork.plans.registry import ORACLES, query
from siltwork.sources.paged import arriving_pages, store_pages, stored_pages
from siltwork.streaming import ingest as I
from siltwork.streaming.entities import resolve_arriving
from siltwork.streaming.retention import expirations


def folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = 100) -> DataFrame:
    return I.arriving(spark, sf_dir, table(spark, sf_dir, name).schema, f"{name}.parquet", files_at_once)


@query("SELECT 'd' || (doc_id // 3) AS id, count(*) > 0 AS stored FROM documents GROUP BY 1")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they arrive, each id stored once."""
    rows = stream(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.expr("doc_id div 3")).alias("id"), "source")
    return I.ingest(rows, "id", folder(spark, "ingest")).select("id", F.lit(True).alias("stored"))


@query("SELECT event_type AS source, user_id AS node, count(*) AS seen, count(*) FILTER (WHERE value > 150) AS hits FROM events GROUP BY 1, 2")
def visit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of nodes, kept while events arrive."""
    rows = stream(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("node"), "value")
    return I.count_by_key(rows, ["source", "node"], F.col("value") > 150, folder(spark, "visits"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, count(*) AS calls FROM events GROUP BY 1, 2")
def budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each provider per calendar day, while they arrive."""
    # All files in one step: their order is not that of time, and what is late would be lost.
    rows = stream(spark, sf_dir, "events", None).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("provider"))
    return I.daily_budget(rows, "ts", ["provider"], folder(spark, "budget"))


@query(ORACLES[entity_resolution.__name__])
def entity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors and hosts that arrive in three runs, by the thirds of their range, with entities kept between."""
    where = folder(spark, "entities")
    key = F.split("key", ":", 2)
    rows = mentions(spark, sf_dir).select(
        "arrival", "kind", "name", "norm", *[F.when(key[0] == k, key[1]).alias(k) for k in ("domain", "github", "linkedin", "handle")], "source", "candidate"
    )
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    found = None
    for turn in range(3):
        part = F.floor((F.col("arrival") - low) * 3 / (high - low + 1))
        rows.where(part == turn).write.mode("append").parquet(f"{where}/arrived")
        found = resolve_arriving(spark.readStream.schema(rows.schema).parquet(f"{where}/arrived"), f"{where}/state")
    return found


PAGES_SQL = "SELECT source AS node, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS page, CAST(doc_id AS VARCHAR) AS id, lang AS author, sha256(coalesce(text, '')) AS body_sha256 FROM documents"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts, fifty to a page of their source."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("node"), "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("author"), F.lit("t").alias("title"), F.col("text").alias("body"))
    placed = rank_within(rows, ["node"], [F.col("doc_id")], "place", "all")
    return placed.withColumn("page", ((F.col("place") - 1) / 50).cast("int"))


def shown(read: DataFrame) -> DataFrame:
    return read.select("node", "page", "id", "author", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha256"))


@query(PAGES_SQL)
def paged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts read back from stored pages, one task per node, until its short page."""
    where = folder(spark, "pages")
    store_pages(posts(spark, sf_dir), where)
    return shown(stored_pages(spark, where, 50))


@query(PAGES_SQL)
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream that stops and goes on when later pages have come."""
    where, out = folder(spark, "pages"), folder(spark, "read")
    placed = posts(spark, sf_dir).checkpoint()
    half = F.col("all") / 100
    for part in (F.col("page") < half, F.col("page") >= half):
        store_pages(placed.where(part), where)
        stream = arriving_pages(spark, where).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/progress")
        stream.trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.parquet(f"{out}/table"))


@query("""
    WITH k AS (SELECT event_type || '-' || user_id AS key, max(epoch_ms(ts)) + 259200000 AS until FROM events GROUP BY 1)
    SELECT key, until FROM k WHERE until < (SELECT max(epoch_ms(ts)) FROM events)
""")
def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of events that nothing kept for three days more, told by timers of a stream."""
    where = folder(spark, "retention")
    at = F.col("ts").cast("timestamp")
    # All files in one step, as above.
    rows = stream(spark, sf_dir, "events", None).select(F.concat_ws("-", "event_type", "user_id").alias("id"), at.alias("at"), (at + F.expr("INTERVAL 3 DAYS")).alias("until"))
    told = expirations(rows, "id", "at", "until")
    told.writeStream.format("parquet").option("path", f"{where}/table").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{where}/table")
