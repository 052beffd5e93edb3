"""Global ranks without a single task: sorted ranges and their offsets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir of the session; on one machine, where none is named, a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltwork-"))


class Stored:
    """Tables written between rounds, in the shared folder of checkpoints: no lineage behind them."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def global_rank(rows: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds each row's place, from 1, in a total order over all rows.

    Rows are sorted into ranges; each range counts its own, and only the counts, one per
    range, are summed in order. The ranges come from a sample, so they are stored: dealt a
    second time for the counts, rows would fall into other ranges.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = local.groupBy("__part").agg(F.max("__at").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return local.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def append_rows(rows: DataFrame, written: DataFrame | None, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """Rows not yet written, with the number of the sheet's row each is appended as.

    ``written`` has one row per row below the sheet's header, or is None for a sheet with none.
    """
    if written is None:
        return global_rank(rows, order, "__place").withColumn(name, F.col("__place") + 1).drop("__place")
    lines = written.agg((F.count(F.lit(1)) + 1).alias("__lines"))
    fresh = global_rank(rows.join(written.select(key), key, "left_anti"), order, "__place")
    return fresh.crossJoin(F.broadcast(lines)).withColumn(name, F.col("__place") + F.col("__lines")).drop("__place", "__lines")


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str, running: tuple[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds each row's place within its keys, how many rows these have, and a running sum if asked.

    ``running`` names a number and the column of its sums up to the row. Rows are sorted into
    ranges by keys and order; each range counts and sums its own rows, and these counts are
    added up, so one key that holds a third of all rows is spread over many tasks.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(running[0]).cast("long") if running else F.lit(0)
    ranged = rows.withColumn("__v", F.coalesce(value, F.lit(0))).repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy(*keys, "__part")
    so_far = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"__at": F.row_number().over(own.orderBy(*order)), "__sum": F.sum("__v").over(so_far)})
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__os"), F.sum("__n").over(whole).alias(total))
    match = F.col("__part") == F.col("__p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = local.join(offsets, match).withColumn(name, F.col("__at") + F.col("__o"))
    if running:
        placed = placed.withColumn(running[1], F.col("__sum") + F.col("__os"))
    return placed.drop("__v", "__part", "__at", "__sum", "__p", "__o", "__os", *[f"__k_{k}" for k in keys])
