"""Calls of models: which are answered from a cache, and which provider takes the others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.operators.ranking import ensure_checkpoint_dir, rank_within

CACHE_SECONDS = 12 * 3600


def _chain(at: np.ndarray, life: int) -> np.ndarray:
    """Of each call, if it is a miss, the last miss that follows from it within these calls of one key."""
    following = np.searchsorted(at, at + life, side="left")
    last = np.arange(len(at) + 1)
    for i in range(len(at) - 1, -1, -1):
        if following[i] < len(at):
            last[i] = last[following[i]]
    return last[:-1]


def _misses(at: np.ndarray, life: int, entry: int | None) -> np.ndarray:
    """The time of the last miss at each call, itself included, given the last miss before them."""
    out = np.empty(len(at), np.int64)
    i = 0
    if entry is not None:
        i = int(np.searchsorted(at, entry + life, side="left"))
        out[:i] = entry
    while i < len(at):
        j = max(int(np.searchsorted(at, at[i] + life, side="left")), i + 1)
        out[i:j] = at[i]
        i = j
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The calls of a task, key by key: they come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("__key").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and held[-1].column("__key")[0].as_py() != keys[a]:
                yield held[-1].column("__key")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[-1].column("__key")[0].as_py(), pa.Table.from_batches(held)


def cache_outcomes(calls: DataFrame, keys: Sequence[str], at: str, life: int = CACHE_SECONDS, parts: int | None = None) -> DataFrame:
    """Adds ``filled_at`` (seconds) and ``hit`` to calls in order of time ``at`` (whole seconds).

    A call is a miss, and fills the cache, if its keys' last miss is ``life`` seconds or more
    ago; all others are hits, and count from that miss and not from each other. Of calls in one
    second the first is the miss; which one that is follows the other columns' order, and all
    have the same ``filled_at``. Null keys are keys of their own; a null time is never cached.

    Calls are sorted into ranges by key and time. A range tells of its first and last key, for
    each miss that may come before, which miss leaves it; these few rows are put together per
    key, and each range then places its calls by the miss that enters it. So one key with a
    third of all calls is spread over many tasks.
    """
    ensure_checkpoint_dir(calls.sparkSession)
    parts = parts or int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    timed = calls.withColumns({"__key": key, "__at": F.col(f"`{at}`").cast("long")})
    order = ["__key", "__at", *[c for c in calls.columns if calls.schema[c].dataType.typeName() not in ("map", "variant")]]
    ranged = timed.where("__at IS NOT NULL").repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order).checkpoint()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range's first and last key: bounds up to which an entering miss, with its life, leads to the same leaving one."""
        found = []
        for name, table in _runs(batches):
            times = table.column("__at").to_numpy()
            leaving = times[_chain(times, life)]
            reach = int(np.searchsorted(times, times[0] + life, side="left")) + 1
            change = np.flatnonzero(np.r_[np.diff(leaving[:reach]) != 0, True])
            row = (name, table.column("__part")[0].as_py(), times[:reach][change].tolist(), leaving[:reach][change].tolist())
            found = [*found[:1], row]
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["key", "part", "bounds", "leaving"])

    def together(table: pa.Table) -> pa.Table:
        """The miss that enters each range of one key."""
        miss, rows = None, []
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            rows.append((r["key"], r["part"], miss))
            i = 0 if miss is None else int(np.searchsorted(r["bounds"], miss + life, side="left"))
            if miss is None or i < len(r["bounds"]):
                miss = r["leaving"][i]
        columns = list(zip(*rows))
        return pa.table({"key": pa.array(columns[0]), "part": pa.array(columns[1], pa.int32()), "entry": pa.array(columns[2], pa.int64())})

    summary = ranged.select("__key", "__at", "__part").mapInArrow(summaries, "key string, part int, bounds array<long>, leaving array<long>")
    entries = summary.groupBy("key").applyInArrow(together, "key string, part int, entry long").where("entry IS NOT NULL")
    entries = entries.select(F.col("key").alias("__k"), F.col("part").alias("__p"), F.col("entry").alias("__entry"))
    # At most one key enters a range, so there are no more rows than ranges.
    entered = ranged.join(F.broadcast(entries), (F.col("__part") == F.col("__p")) & (F.col("__key") == F.col("__k")), "left").drop("__p", "__k")
    names, kept = calls.columns, ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in calls.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches):
            times, entry = table.column("__at").to_numpy(), table.column("__entry")[0].as_py()
            filled = _misses(times, life, entry)
            miss = (filled == times) & np.r_[True, filled[1:] != filled[:-1]]
            if entry is not None:
                miss[0] = filled[0] != entry
            out = table.select(names).append_column("filled_at", pa.array(filled)).append_column("hit", pa.array(~miss))
            yield from out.to_batches()

    placed = entered.mapInArrow(place, f"{kept}, filled_at long, hit boolean")
    unknown = timed.where("__at IS NULL").select(*[f"`{c}`" for c in calls.columns], F.lit(None).cast("long").alias("filled_at"), F.lit(False).alias("hit"))
    return placed.unionByName(unknown)


def routed(calls: DataFrame, day: str, order: Sequence[Column], ladder: Sequence[tuple[str, int, Column]]) -> DataFrame:
    """Adds ``provider``: calls in order fill each provider's budget of a day, best provider first.

    ``ladder`` has a name, calls a day, and which calls the provider may take; private calls
    belong on the rungs of local endpoints alone. A call goes to the first provider that may
    take it and has something left on its day; with none left it has null. As each call asks
    the best provider first, that one takes the first calls it may have, the next the first of
    the others, and so on: one pass per rung, each over ranges and not over a day as a whole.
    A null day is a day of its own.
    """
    name, place = "provider", "__place"
    left, done = calls, None
    for provider, budget, may in ladder:
        able = F.coalesce(may, F.lit(False))
        ranked = rank_within(left.withColumn("__able", able), [day, "__able"], order, place, "__all").drop("__all")
        takes = F.col("__able") & (F.col(place) <= budget)
        ranked = ranked.withColumn("__takes", takes).drop("__able", place).checkpoint()
        taken = ranked.where("__takes").drop("__takes").withColumn(name, F.lit(provider))
        left, done = ranked.where("NOT __takes").drop("__takes"), taken if done is None else done.unionByName(taken)
    rest = left.withColumn(name, F.lit(None).cast("string"))
    return rest if done is None else done.unionByName(rest)
