"""Dossiers of entities: evidence, best signals with their quotes, best thesis, warm paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.functions import text as T
from siltwork.operators.ranking import rank_within

#: What kind of path a shared place of each source is, and how strong.
PATH_KINDS = {"whatsapp": "whatsapp_group", "reddit": "same_subreddit", "substack": "same_publication", "github": "github_org"}
STRENGTH = {"whatsapp_group": 1.00, "github_org": 0.60, "same_subreddit": 0.35, "same_publication": 0.25}
PATH_WORDS = {"whatsapp_group": "%s is in your %s group", "github_org": "%s appears in the %s org", "same_subreddit": "%s also posts in r/%s", "same_publication": "%s also writes in %s"}


def pick(values: Mapping[str, float | str], key: Column, default=None) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def evidence_of(bridge: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each entity, with their ``worth`` (score, else similarity) and place by it."""
    joined = bridge.join(candidates, "candidate")
    worth = F.coalesce("score", "similarity")
    return rank_within(joined.withColumn("worth", worth), ["entity"], [F.col("worth").desc_nulls_last(), F.col("candidate")], "place", "__all").drop("__all")


def author_of(evidence: DataFrame) -> DataFrame:
    """entity, author: the author of the entity's first candidate that has one."""
    return evidence.where("author IS NOT NULL").groupBy("entity").agg(F.min_by("author", "candidate").alias("author"))


def warm_paths(evidence: DataFrame, candidates: DataFrame, per_node: int = 25, most: int = 10) -> DataFrame:
    """entity, place, kind, via, person, strength of the strongest paths to each entity.

    Other authors of a place (source, node) where the entity was seen. Authors are first made
    distinct per place and cut to ``per_node`` by name, which is the feature's own limit, so a
    crowded place joins so many rows per entity at most. Of one person and kind the first place
    by name counts.
    """
    kinds = candidates.where(F.col("source").isin(*PATH_KINDS))
    # One more than the limit, as the entity's own author may be among them.
    w = Window.partitionBy("source", "node").orderBy("person")
    people = kinds.where("node IS NOT NULL AND author IS NOT NULL").select("source", "node", F.col("author").alias("person")).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node + 1)
    own = author_of(evidence).withColumnRenamed("author", "me")
    places = evidence.where("node IS NOT NULL").select("entity", "source", "node").distinct().join(own, "entity")
    met = places.join(people, ["source", "node"]).where("person != me")
    turn = Window.partitionBy("entity", "source", "node").orderBy("person")
    met = met.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_node)
    kind = pick(PATH_KINDS, F.col("source"))
    paths = met.select("entity", "person", "node", kind.alias("kind")).groupBy("entity", "kind", "person").agg(F.min("node").alias("via"))
    rated = paths.withColumn("strength", pick(STRENGTH, F.col("kind")).cast("double"))
    order = Window.partitionBy("entity").orderBy(F.desc("strength"), "via", "person")
    return rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def describe_path(kind: Column, via: Column, person: Column) -> Column:
    """An observation, no claim that the two know each other."""
    out = F.lit(None).cast("string")
    for name, words in PATH_WORDS.items():
        out = F.when(kind == name, F.format_string(words, person, via)).otherwise(out)
    return out


def reachability(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """entity, reachable: the strongest path, 0 without one."""
    best = paths.groupBy("entity").agg(F.max("strength").alias("reachable"))
    return entities.select("entity").join(best, "entity", "left").na.fill(0.0, ["reachable"])


def best_signals(evidence: DataFrame, signals: Sequence[str]) -> DataFrame:
    """entity, signal, score, quote, fabricated, source, url: of each signal the best score.

    ``evidence`` has a struct(score, quote) column per signal. Of equal scores the first
    evidence by place counts. A quote that does not stand in its text is blanked and marked.
    """
    stacked = evidence.select("entity", "place", "source", "url", "text", F.explode(F.create_map(*[c for s in signals for c in (F.lit(s), F.col(s))])).alias("signal", "v"))
    score = F.coalesce("v.score", F.lit(0.0))
    best = stacked.groupBy("entity", "signal").agg(F.max_by(F.struct(score.alias("score"), T.strip(F.coalesce("v.quote", F.lit(""))).alias("quote"), "source", "url", "text"), F.struct(score, -F.col("place"))).alias("b"))
    real = T.quote_in(F.col("b.quote"), F.col("b.text"))
    return best.select("entity", "signal", "b.score", F.when(real, F.col("b.quote")).otherwise("").alias("quote"), ((F.col("b.quote") != "") & ~real).alias("fabricated"), "b.source", "b.url")


def score_theses(best: DataFrame, sources: DataFrame, weights: DataFrame) -> DataFrame:
    """entity, thesis, score for the best thesis of each entity, the first in order on ties.

    ``best`` has the best signals, ``sources`` entity, sources (their number) and penalty,
    ``weights`` thesis, ord, signal, weight. Weighted signals over the positive weights, held
    in 0 to 1, raised for several sources, less the penalty.
    """
    totals = weights.groupBy("thesis", "ord").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("total"))
    sums = best.join(F.broadcast(weights), "signal").groupBy("entity", "thesis", "ord").agg(F.sum(F.col("score") * F.col("weight")).alias("sum"))
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("sum", "total"), F.lit(0.0))))
    rated = sums.join(F.broadcast(totals), ["thesis", "ord"]).join(sources, "entity").withColumn("score", F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * S.corroboration(F.col("sources"))) - F.col("penalty")), 9), 4))
    return rated.groupBy("entity").agg(F.max_by(F.struct("thesis", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("entity", "b.*")
