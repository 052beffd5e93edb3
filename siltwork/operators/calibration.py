"""Thresholds and weights from judged rows, and models that decide what to review and accept."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.operators.ranking import global_rank, rank_within


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    return F.coalesce(F.try_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall), F.lit(0.0))


def sweep(rows: DataFrame, score: str, good: str, beta: float) -> DataFrame:
    """Precision, recall and F at the thresholds 0.05 to 0.95 at which rows are left.

    Every row counts once in the bucket of the highest threshold it reaches; counts from the
    top down give all thresholds at once.
    """
    reached = F.greatest(F.lit(4), F.least(F.lit(95), F.floor(F.round(F.col(score) * 100, 9)).cast("int")))
    counts = rows.groupBy(reached.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(good).cast("long")).alias("g"))
    steps = rows.sparkSession.range(4, 96).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").na.fill(0, ["n", "g"])
    down = Window.orderBy(F.desc("step"))
    cumulated = steps.select("step", F.sum("n").over(down).alias("kept"), F.sum("g").over(down).alias("hits"), F.sum("g").over(Window.partitionBy()).alias("positives"))
    table = cumulated.where("step >= 5 AND kept > 0")
    precision, recall = F.col("hits") / F.col("kept"), F.coalesce(F.try_divide(F.col("hits"), F.col("positives")), F.lit(0.0))
    return table.select((F.col("step") / 100).alias("threshold"), "kept", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall, 1.0).alias("f1"), f_beta(precision, recall, beta).alias("score"))


def fit_threshold(table: DataFrame) -> DataFrame:
    """The row of the best score, the lowest threshold on ties, and the floor that goes with it."""
    best = table.agg(F.min_by(F.struct("threshold", "precision", "recall", "f1", "score"), F.struct((-F.round("score", 12)).alias("s"), "threshold")).alias("b"))
    return best.select("b.*", F.round(F.greatest(F.lit(0.05), F.col("b.threshold") * 0.7), 2).alias("floor"))


def average_precision(rows: DataFrame, score: Column, good: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean precision at the places of good rows, per key; a fixed order breaks ties."""
    ordered = rows.withColumn("__score", score)
    placed = rank_within(ordered, keys, [F.desc("__score"), F.col(tie)], "place", "n", (good, "hit")).where(F.col(good) == 1)
    return placed.groupBy(*keys).agg((F.sum(F.col("hit") / F.col("place")) / F.count(F.lit(1))).alias("average_precision"))


def weight_grid(step: float = 0.05) -> list[tuple[float, float, float]]:
    """All triples of weights on the grid that add up to one."""
    n = round(1 / step)
    return [(round(a * step, 2), round(b * step, 2), round((n - a - b) * step, 2)) for a in range(n + 1) for b in range(n + 1 - a)]


def best_weights(table: DataFrame, judged: int, least: int = 40) -> DataFrame:
    """The triple of the best average precision, the first one on ties; none below so many judged rows."""
    best = table.groupBy().agg(F.min_by(F.struct("ws", "wt", "average_precision"), F.struct((-F.round("average_precision", 9)).alias("a"), "ws", "wt")).alias("b"))
    return best.where(F.lit(judged >= least)).select("b.ws", "b.wt", F.round(1 - F.col("b.ws") - F.col("b.wt"), 2).alias("wr"), "b.average_precision")


def fit_caveats(labels: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """positive_rate, gap, caveats of a fit: what to mind before it is believed.

    ``labels`` has similarity and good, ``corpus`` the similarities of all candidates. The gap is
    the share of the corpus's range below the lowest labelled row.
    """
    rates = labels.agg(F.avg(F.col("good").cast("double")).alias("positive_rate"), F.min("similarity").alias("low"))
    span = corpus.agg(F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    both = rates.crossJoin(F.broadcast(span)).withColumn("gap", F.coalesce(F.try_divide(F.col("low") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))
    notes = F.array_compact(F.array(
        F.when(F.col("positive_rate") > 0.8, "labels come from the top of the ranking"),
        F.when(F.col("positive_rate") < 0.05, "very few positives"),
        F.when(F.col("gap") > 0.25, "the low end was never labelled"),
        F.when(F.lit(threshold) <= 0.10, "the threshold keeps almost everything"),
    ))
    return both.select("positive_rate", "gap", notes.alias("caveats"))


def choose_size(curve: DataFrame, most_check: float = 0.05) -> DataFrame:
    """The portfolio size (n) of the best odds among those that keep every cheque small enough, the
    smallest on ties, and whether that floor or the odds decide."""
    floor = max(1, math.ceil(1 / most_check))
    able = curve.where(F.col("n") >= floor).agg(F.min_by(F.struct("n", "prob", "expected"), F.struct((-F.col("prob")).alias("p"), "n")).alias("b"))
    return able.select("b.*", F.lit(floor).alias("n_floor"), F.when(F.col("b.n") == floor, "capacity").otherwise("objective").alias("binding"))


def histogram(rows: DataFrame, score: str, bins: int = 40) -> DataFrame:
    """bin, n of scores held in 0 to 1; the top edge belongs to the last bin."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return rows.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(held * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def acceptance_bars(shares: Mapping[int, float], arrivals: int, slots: int, bins: int = 40) -> list[list[float]]:
    """Bars by (arrivals left, slots left): what holding a slot is worth, built from the end.

    ``shares`` has the probability of each histogram bin; without any, all are alike.
    """
    values = [(i + 0.5) / bins for i in range(bins)]
    odds = [shares.get(i, 0.0) for i in range(bins)] if shares else [1 / bins] * bins
    worth = [[0.0] * (slots + 1)]
    bars = [[0.0] * (slots + 1)]
    for _ in range(arrivals):
        last, now = worth[-1], [0.0] * (slots + 1)
        for m in range(1, slots + 1):
            now[m] = sum(p * max(x + last[m - 1], last[m]) for x, p in zip(values, odds) if p)
        bars.append([0.0] + [max(0.0, last[m] - last[m - 1]) for m in range(1, slots + 1)])
        worth.append(now)
    return bars


def hill_index(rows: DataFrame, value: str) -> DataFrame:
    """n, k, alpha: the tail index from the k = int(sqrt(n)) largest values (2 at least)."""
    positive = rows.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x"))
    n = positive.agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.greatest(F.lit(2), F.floor(F.sqrt("n")).cast("int")), (F.col("n") - 1).cast("int"))
    ranked = global_rank(positive, [F.desc("x")], "place").crossJoin(F.broadcast(n)).withColumn("k", k)
    tail = ranked.where("place <= k + 1").groupBy("n", "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), F.log("x"))).alias("logs"), F.min("x").alias("edge"))
    gamma = (F.col("logs") - F.col("k") * F.log("edge")) / F.col("k")
    return tail.where("n >= 3").select("n", "k", F.when(gamma > 0, 1 / gamma).otherwise(float("inf")).alias("alpha"))


def hit_rate(place: Column, top: float = 0.10, fall: float = 0.35) -> Column:
    """Hit rate by rank: a power law that starts at ``top``."""
    return F.least(F.lit(1.0), top * F.pow(place.cast("double"), F.lit(-fall)))


def portfolio_curve(spark, pipeline: int, alpha: float = 1.8, skill: float = 1.0, most_check: float = 0.05) -> DataFrame:
    """n, prob, expected: odds of one fund-returning position, and their number, by size."""
    floor = max(1, math.ceil(1 / most_check))
    ranks = spark.range(1, pipeline + 1).select(F.col("id").alias("place"), hit_rate(F.col("id")).alias("p"))
    mean = ranks.agg(F.avg("p").alias("mean"))
    sizes = spark.range(1, min(pipeline, max(3 * floor, 60)) + 1).withColumnRenamed("id", "n")
    seen = sizes.join(ranks, F.col("place") <= F.col("n")).crossJoin(F.broadcast(mean)).withColumn("q", (skill * F.col("p") + (1 - skill) * F.col("mean")) * F.pow(F.col("n").cast("double"), F.lit(-alpha)))
    return seen.groupBy("n").agg((1 - F.exp(F.sum(F.log1p(-F.col("q"))))).alias("prob"), F.sum("q").alias("expected"))
