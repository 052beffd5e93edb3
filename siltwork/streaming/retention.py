"""Retention in a stream: stored rows expire by timers, and what hangs on them is told to go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = StructType([StructField("key", StringType()), StructField("until", LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """Of each key the time until which it is kept; a later row of the key moves it, a timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("until", StructType([StructField("until", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = max(int(r["until"].max()) for r in rows)
        if self.kept.exists():
            before = self.kept.get()[0]
            until = max(until, before)
            self.handle.deleteTimer(before)
        self.kept.update((until,))
        self.handle.registerTimer(until)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.kept.get()[0]
        self.kept.clear()
        yield pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "until": pd.Series([until], dtype="int64")})

    def close(self) -> None:
        """Nothing is held beside the state."""


def millis(at: Column) -> Column:
    """Milliseconds of a time, its microseconds rounded to the nearest, halves away from 1970."""
    return (F.round(F.unix_micros(at), -3) / 1000).cast("long")


def expirations(rows: DataFrame, key: str, at: str, until: str) -> DataFrame:
    """key, until (milliseconds) of rows whose time is over, as a stream.

    ``rows`` is a stream with the key, the time it was stored ``at`` (its clock: what is over is
    told by the latest of these) and the time ``until`` which it is kept. A later row of a key
    that is still kept moves its end further away. A key is told once, then it is forgotten, so
    the state holds only what is kept. Rows without a key or an end are never told. All times are
    rounded to milliseconds. A step's rows may come in any order, but the steps must come in the
    order of ``at``: a row older than all of an earlier step is late. Timers need the RocksDB
    state store, which is set for the session's streams.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    able = rows.where(F.col(key).isNotNull() & F.col(until).isNotNull())
    timed = able.select(F.col(key).cast("string").alias("key"), F.timestamp_millis(millis(F.col(at))).alias("at"), millis(F.col(until)).alias("until")).withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(Expiry(), OUT, "Append", "EventTime")
