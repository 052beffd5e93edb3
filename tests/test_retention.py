"""Retention by timers against rows one after the other."""

import datetime as dt

from siltwork.streaming.retention import expirations

START = dt.datetime(2024, 1, 1)


def run(spark, folder):
    stream = spark.readStream.schema("id string, at timestamp, until timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    gone = expirations(stream, "id", "at", "until")
    gone.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["key"], r["until"]) for r in spark.read.schema("key string, until long").parquet(f"{folder}/out").collect())


def day(n):
    return START + dt.timedelta(days=n)


def millis(n):
    return int((day(n) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def test_timers(spark, tmp_path):
    folder = str(tmp_path)
    put = lambda rows: spark.createDataFrame(rows, "id string, at timestamp, until timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    put([("a", day(0), day(3)), ("b", day(0), day(9)), ("c", day(1), day(2)), (None, day(1), day(1)), ("d", day(1), None)])
    assert run(spark, folder) == []
    put([("a", day(2), day(6)), ("e", day(5), day(30))])  # a is kept longer; by day five c is over
    assert run(spark, folder) == [("c", millis(2))]
    put([("c", day(6), day(8)), ("f", day(10), day(40))])  # c came back; by day ten a, b and c are over
    assert run(spark, folder) == [("a", millis(6)), ("b", millis(9)), ("c", millis(2)), ("c", millis(8))]


def test_microseconds_are_rounded(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a", day(0), day(3) + dt.timedelta(microseconds=499)), ("b", day(0), day(3) + dt.timedelta(microseconds=500)), ("c", day(9), day(30))]
    spark.createDataFrame(rows, "id string, at timestamp, until timestamp").coalesce(1).write.parquet(f"{folder}/in")
    assert run(spark, folder) == [("a", millis(3)), ("b", millis(3) + 1)]
