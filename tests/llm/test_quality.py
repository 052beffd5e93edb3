"""Quality scores: held-out accuracy, monotone calibration, odd rows."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from siltwork.llm import quality as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Q.score(docs, model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(Q.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([(r["score"] >= Q.THRESHOLD) == r["quality"] for r in rows]) > 0.97


def test_isotonic_is_monotone():
    x, y = np.arange(9.0), np.array([0, 1, 0, 0, 1, 0.5, 1, 1, 0.9])
    knots, levels = Q.isotonic(x, y, np.ones(9))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()


def test_partition_sums_do_not_depend_on_partitions(spark):
    from siltwork.llm.shared import matrix, partition_sums

    rows = spark.createDataFrame([([float(i), 1.0],) for i in range(50)], "vector array<double>")
    for parts in (1, 7):
        total = partition_sums(rows.repartition(parts), (2, 2), lambda b: matrix(b).T @ matrix(b))
        assert total.tolist() == [[40425.0, 1225.0], [1225.0, 50.0]]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 100_000), (4, "word " * 100_000), (None, "x"), (5, "é ñ 😀")]
    got = Q.score(spark.createDataFrame([(i, t, 9.0, "s") for i, t in rows], "doc_id long, text string, score double, statistics string"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert Q.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert [r["score"] for r in Q.score(docs, model).collect()] == [0.5, 0.5]
