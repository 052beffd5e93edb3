"""Incremental work over files that arrive: ingestion, counters and daily budgets as streams.

Each function starts a stream that takes what is there and ends, and returns the stored table;
run again with the same folder it goes on where it stopped. State and output live in the shared
folder, so a lost executor or a restart repeats no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def arriving(spark: SparkSession, folder: str, schema, name: str, files_at_once: int | None = 100) -> DataFrame:
    """A table of a folder as a stream: a Parquet file, all that match a pattern, or a folder of parts.

    Some files per step; None takes all that are there at once.
    """
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    if is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, work, folder: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(work).start()
    query.awaitTermination()


def ingest(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """Stores each key once: the first row of it that arrives; rows already stored are passed over.

    A batch that is repeated after a failure overwrites its own part, so nothing is stored twice.
    """
    spark = rows.sparkSession
    table = f"{folder}/table"

    def store(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        if exists(spark, table):
            known = spark.read.parquet(table).where(F.col("batch") != number).select(key)
            new = new.join(known, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")

    run_available(rows, store, folder)
    return spark.read.parquet(table).drop("batch")


def count_by_key(rows: DataFrame, keys: list[str], hit, folder: str) -> DataFrame:
    """keys, seen, hits: running counters, kept by the stream's state and stored as they change."""
    spark = rows.sparkSession
    table = f"{folder}/table"
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.count_if(hit).alias("hits"))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    run_available(counted, store, folder, "update")
    last = spark.read.parquet(table).groupBy(*keys).agg(F.max_by(F.struct("seen", "hits"), "at").alias("c"))
    return last.select(*keys, "c.*")


def daily_budget(calls: DataFrame, at: str, keys: list[str], folder: str, late: str = "2 days") -> DataFrame:
    """day, keys, calls: calls per calendar day; a day is final once no call of it can come any more.

    Days still open at the end are taken from the state, so all calls count.
    """
    spark = calls.sparkSession
    table = f"{folder}/table"
    daily = calls.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), *keys).agg(F.count(F.lit(1)).alias("calls"))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    run_available(daily, store, folder, "update")
    last = spark.read.parquet(table).groupBy("day", *keys).agg(F.max_by("calls", "at").alias("calls"))
    return last.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), *keys, "calls")
