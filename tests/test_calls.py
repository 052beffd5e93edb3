"""Caches and budgets against one call after the other."""

import random

import pytest
from pyspark.sql import functions as F

from siltwork.operators.calls import cache_outcomes, routed


def cached(calls, life):
    out, filled = [], {}
    for i, key, at in sorted(calls, key=lambda c: (str(c[1]), c[2] if c[2] is not None else 0, c[0])):
        if at is None:
            out.append((i, None, False))
            continue
        hit = key in filled and at < filled[key] + life
        if not hit:
            filled[key] = at
        out.append((i, filled[key], hit))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4, 23])
@pytest.mark.parametrize("spread", [300, 3000])
def test_cache(spark, parts, spread):
    r = random.Random(spread + parts)
    calls = [(i, r.choice(("hot", "hot", "hot", "b", "c", None)), r.randrange(spread) if r.random() < 0.98 else None) for i in range(600)]
    got = cache_outcomes(spark.createDataFrame(calls, "id long, key string, t long"), ["key"], "t", 60, parts)
    assert got.columns == ["id", "key", "t", "filled_at", "hit"]
    assert sorted((x["id"], x["filled_at"], x["hit"]) for x in got.collect()) == cached(calls, 60)


def test_cache_of_nothing(spark):
    assert cache_outcomes(spark.createDataFrame([], "id long, key string, t long"), ["key"], "t", 60).collect() == []


def test_budgets(spark):
    r = random.Random(1)
    calls = [(i, r.choice(("mon", "mon", "tue", None)), r.random() < 0.3, r.randrange(4)) for i in range(300)]
    ladder = [("a", 20, lambda c: not c[2] and c[3] > 0), ("b", 15, lambda c: not c[2]), ("c", 0, lambda c: True), ("local", 30, lambda c: True)]
    used, want = {}, {}
    for c in calls:
        want[c[0]] = next((n for n, budget, may in ladder if may(c) and used.get((n, c[1]), 0) < budget), None)
        used[(want[c[0]], c[1])] = used.get((want[c[0]], c[1]), 0) + 1
    public = ~F.col("private")
    rungs = [("a", 20, public & (F.col("kind") > 0)), ("b", 15, public), ("c", 0, F.lit(True)), ("local", 30, F.lit(True))]
    rows = spark.createDataFrame(calls, "id long, day string, private boolean, kind int")
    assert {x["id"]: x["provider"] for x in routed(rows, "day", [F.col("id")], rungs).collect()} == want
    assert all(want[c[0]] in ("local", None) for c in calls if c[2])
