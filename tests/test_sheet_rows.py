"""Row numbers of an append-only sheet."""

from pyspark.sql import functions as F

from siltwork.operators import ranking
from siltwork.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_all_candidates_get_rows_below_the_header(spark):
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    placed = sorted(ids, key=lambda i: (i * 37 % 720, i))
    found = {r.doc_id: r.sheet_row for r in catalogue.QUERIES["sheet_rows"](spark, DATA).collect()}
    assert found == {i: n for n, i in enumerate(placed, 2)}


def test_new_rows_go_below_the_written_ones(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    written = spark.createDataFrame([(n,) for n in (3, 50, 99, 1000)], "doc_id long")
    found = {r.doc_id: r.n for r in ranking.append_rows(rows, written, "doc_id", [F.desc("doc_id")], "n").collect()}
    assert found == {i: n for n, i in enumerate([i for i in range(99, -1, -1) if i not in (3, 50, 99)], 6)}
    assert ranking.append_rows(rows, rows, "doc_id", [F.desc("doc_id")], "n").count() == 0


def test_numbers_hold_where_ranges_come_from_a_sample(spark):
    data = "/root/testdata/sf0.1"
    ids = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    placed = sorted(ids, key=lambda i: (i * 37 % 720, i))
    found = {r.doc_id: r.sheet_row for r in catalogue.QUERIES["sheet_rows"](spark, data).collect()}
    assert found == {i: n for n, i in enumerate(placed, 2)}
