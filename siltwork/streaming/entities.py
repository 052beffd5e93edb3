"""Entities kept between runs: mentions arrive as a stream, entities and evidence are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.entities import ENTITY, resolve_more
from siltwork.streaming.ingest import exists, run_available


def stored_entities(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The stored entities, each as the latest batch left it; None if nothing is stored yet."""
    if not exists(spark, f"{folder}/entities"):
        return None
    rows = spark.read.parquet(f"{folder}/entities")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*ENTITY[1:]), "batch").alias("e")).select("entity_id", "e.*")


def resolve_arriving(mentions: DataFrame, folder: str) -> DataFrame:
    """entity_id, kind, name, sources, mentions, first_at, last_at, needs_review after all that has arrived.

    ``mentions`` is a stream of rows as ``resolve`` takes them; what arrives later must have
    higher arrivals. Each batch reads the stored entities, and appends those that it makes or
    changes and their evidence. A batch that is repeated after a failure reads what was there
    before it and overwrites its own part, so nothing counts twice. Run again with the same
    folder it goes on where it stopped.
    """
    spark = mentions.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        changed, evidence = resolve_more(batch, stored_entities(batch.sparkSession, folder, number))
        evidence.write.mode("overwrite").parquet(f"{folder}/evidence/batch={number}")
        changed.write.mode("overwrite").parquet(f"{folder}/entities/batch={number}")

    run_available(mentions, store, folder)
    counts = spark.read.parquet(f"{folder}/evidence").groupBy("entity_id").agg(F.count_distinct("candidate").alias("mentions"))
    whole = stored_entities(spark, folder).join(counts, "entity_id", "left")
    return whole.select("entity_id", "kind", "name", F.array_join("sources", ",").alias("sources"), F.coalesce("mentions", F.lit(0)).alias("mentions"), "first_at", "last_at", "needs_review")
