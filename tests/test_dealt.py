"""Texts dealt over tasks, and terms found in them."""

from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.plans.frames import ROWS_IN_TASK, dealt


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(ROWS_IN_TASK * 6).select(F.col("id").alias("doc_id"), F.lit("x" * 2000).alias("text")).coalesce(1)
    found = dealt(rows, "doc_id")
    assert found.rdd.getNumPartitions() == 6
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < ROWS_IN_TASK * 1.2
    assert dealt(rows.limit(10), "doc_id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_terms(spark):
    rows = spark.createDataFrame([(0, "An API, built"), (1, None), (2, "")], "n int, text string")
    found = rows.orderBy("n").select(T.term_hits(F.col("text"), ("Built", "api", "demo")), T.term_hits(F.lower("text"), ("Built", "api"), lowered=True), T.any_term(F.lower("text"), ("API",), lowered=True)).collect()
    assert list(map(tuple, found)) == [(["Built", "api"], ["Built", "api"], True), ([], [], None), ([], [], False)]
