"""Streams over tables that lie in folders of parts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltwork.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    for name in ("documents", "events"):
        spark.read.parquet(str(DATA / f"{name}.parquet")).repartition(3).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def rows(spark, name, where):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(where)).collect()))


@pytest.mark.parametrize("name", ["ingest_stream", "visit_stream", "budget_stream"])
def test_folder_of_parts(spark, parts, name):
    found = rows(spark, name, parts)
    assert found and found == rows(spark, name, DATA)


def test_retention_over_parts_in_any_order(spark, tmp_path):
    """More parts than a step takes by default, their times in no order; ends to the millisecond."""
    events = spark.read.parquet(str(DATA / "events.parquet"))
    events.repartition(120).write.parquet(str(tmp_path / "events.parquet"))
    rounded = "(unix_micros(cast(ts as timestamp)) + 500) div 1000"
    k = events.groupBy(F.concat_ws("-", "event_type", "user_id").alias("key")).agg((F.max(F.expr(rounded)) + 259200000).alias("until"))
    last = events.agg(F.max(F.expr(rounded))).first()[0]
    assert rows(spark, "retention_stream", tmp_path) == sorted(map(tuple, k.where(F.col("until") < last).collect()))
