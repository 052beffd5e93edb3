"""Table operators: ingestion, merges, erasure, gates, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.operators.ranking import rank_within


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Insert-or-ignore: incoming rows of unknown keys, of each key the first to arrive."""
    return first_by(incoming.join(stored.select(key), key, "left_anti"), [key], *order)


def upsert_last(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert-or-replace: an incoming row (one per key) takes the place of a stored one."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def fill_missing(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """Coalescing update: stored values stay, nulls are filled; unknown keys are added.

    Of ``sets`` (arrays) both sides' values count, each once and in order.
    """
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in (*columns, *sets)])
    empty = F.array().cast("array<string>")
    both = [F.array_sort(F.array_union(F.coalesce(c, empty), F.coalesce(f"__{c}", empty))).alias(c) for c in sets]
    return stored.join(new, key, "full_outer").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], *both)


def refresh_captures(stored: DataFrame, captured: DataFrame, key: str, owner: str, own: Sequence[str], fresh: Sequence[str], derived: Sequence[str]) -> DataFrame:
    """Stored rows after pages were captured again: new text, and nothing that describes the old one.

    A row that belongs to one of the ``own`` sources takes the ``fresh`` columns of the capture
    (one per key), and its ``derived`` columns become null; all others, such as a reviewer's
    labels, stay. A row that another source owns stays as it is. Unknown keys are added.
    """
    new = captured.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in fresh], F.lit(True).alias("__new"))
    taken = F.coalesce(F.col("__new"), F.lit(False)) & (F.col(owner).isNull() | F.col(owner).isin(*own))

    def value(c: str) -> Column:
        if c in fresh:
            return F.when(taken, F.col(f"__{c}")).otherwise(F.col(c))
        return F.when(~taken, F.col(c)) if c in derived else F.col(c)

    return stored.join(new, key, "full_outer").select(*[F.col(c) if c == key else value(c).alias(c) for c in stored.columns])


def top_share(rows: DataFrame, group: str, value: str, tie: str, share: float, floor: float) -> DataFrame:
    """The best share of each group among values from ``floor``: at least one, half to even."""
    able = rows.where(F.col(value) >= floor)
    ranked = rank_within(able, [group], [F.desc(value), F.col(tie)], "place", "n")
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("n") * share, 0).cast("int"))).drop("n")


def nearest_rank(rows: DataFrame, group: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Percentiles by position int(n p / 100), the last at most, by a global sort within groups."""
    able = rows.where(F.col(value).isNotNull())
    placed = rank_within(able.select(*group, value), group, [F.col(value)], "place", "n").withColumn("at", F.col("place") - 1)
    picks = [F.max(F.when(F.col("at") == F.least((F.col("n") * p / 100).cast("int"), F.col("n") - 1), F.col(value))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*group).agg(*picks)


def purge(rows: DataFrame, expired: Column, related: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and related rows whose key does not belong to a purged row."""
    gone = rows.where(F.coalesce(expired, F.lit(False)))
    return rows.where(~F.coalesce(expired, F.lit(False))), related.join(gone.select(key), key, "left_anti")
