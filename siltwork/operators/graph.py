"""Entities from mentions, and the frontier of nodes to visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltwork.operators.ranking import Stored
from siltwork.operators.tables import first_by

MAX_DEPTH, MAX_VISITS = 3, 50
MIN_HIT_RATE, MIN_SEEN = 0.02, 20


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """entity_id, kind, name, sources, mentions, first_at, last_at, needs_review of mentions.

    ``mentions`` has arrival (unique), kind, name, norm (the name for comparison), key (an
    identity key or null), source and candidate. Mentions of one key are one entity. Those
    without a key join the entity of their kind and name whose key came first, or else make one
    of their own. An entity is named and numbered after its first mention. It needs review if
    its last mention only matched by name. No step needs an order over all rows: each is an
    aggregate that combines before the shuffle, or an equi-join.
    """
    keyed = mentions.where("key IS NOT NULL")
    groups = keyed.groupBy("key").agg(F.min("arrival").alias("at"), F.min_by("kind", "arrival").alias("kind"), F.min_by("norm", "arrival").alias("norm"))
    owners = groups.where("norm != ''").groupBy("kind", "norm").agg(F.min_by("key", "at").alias("owner"))
    unkeyed = mentions.where("key IS NULL").join(owners, ["kind", "norm"], "left")
    named = F.concat_ws(":", "kind", "norm")
    placed = unkeyed.withColumn("entity", F.coalesce("owner", named)).drop("owner").unionByName(keyed.withColumn("entity", F.col("key")))
    seed = F.coalesce("key", named)
    rolled = placed.groupBy("entity").agg(
        F.min_by(seed, "arrival").alias("seed"),
        F.min_by("kind", "arrival").alias("kind"),
        F.min_by("name", "arrival").alias("name"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count_distinct("candidate").alias("mentions"),
        F.min("arrival").alias("first_at"),
        F.max("arrival").alias("last_at"),
        F.max_by(F.col("key").isNull(), "arrival").alias("last_unkeyed"),
    )
    return rolled.select(
        F.substring(F.sha2("seed", 256), 1, 32).alias("entity_id"),
        "kind", "name", "sources", "mentions", "first_at", "last_at",
        (F.col("last_unkeyed") & (F.col("last_at") > F.col("first_at"))).alias("needs_review"),
    )


def worth_expanding(kind: Column, seen: Column, hits: Column) -> Column:
    """Seeds are, and nodes not yet seen often enough to tell; others by their hit rate."""
    return (kind == "seed") | (seen < MIN_SEEN) | (F.try_divide(hits, seen) >= MIN_HIT_RATE)


def pending(nodes: DataFrame) -> DataFrame:
    """Nodes to visit next, per source: never visited first, then shallow, then long ago."""
    w = Window.partitionBy("source").orderBy(F.col("last_visited").isNotNull(), "depth", "last_visited", "node")
    able = nodes.where((F.col("active") == 1) & (F.col("exhausted") == 0) & (F.col("depth") <= MAX_DEPTH))
    return able.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_VISITS)


def suggestions(nodes: DataFrame, most: int = 20) -> DataFrame:
    """Discovered nodes by measured hit rate, per source."""
    able = nodes.where("kind = 'discovered' AND active = 1 AND seen > 0").withColumn("hit_rate", F.col("hits") / F.col("seen"))
    w = Window.partitionBy("source").orderBy(F.desc("hit_rate"), F.desc("hits"), "node")
    return able.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def coposting(activity: DataFrame, good: DataFrame, known: DataFrame) -> DataFrame:
    """node, authors: nodes not yet known at which good authors post, by how many of them do."""
    return activity.join(good, "author", "left_semi").join(known, "node", "left_anti").groupBy("node").agg(F.count_distinct("author").alias("authors"))


def expand(edges: DataFrame, seeds: DataFrame, most_depth: int = MAX_DEPTH) -> DataFrame:
    """node, depth, parent of all nodes within reach: each at its least depth, of its least parent."""
    known = seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"))
    layer = known
    for depth in range(1, most_depth + 1):
        found = edges.join(layer.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("src").alias("parent"))
        layer = first_by(found.join(known, "node", "left_anti"), ["node"], "parent")
        known = known.unionByName(layer)
    return known


def expand_round(nodes: DataFrame, visits: DataFrame, edges: DataFrame, most_visits: int = MAX_VISITS, most_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """One round of a run with a budget: the nodes visited, and the new nodes that they lead to.

    Per source the first ``most_visits`` pending nodes are visited. ``visits`` says what each
    would yield (source, node, seen, hits), ``edges`` where it leads (source, node, neighbour).
    Only nodes that the gate lets expand, by their counters before the visit, and that are not
    at the deepest level lead on.
    """
    w = Window.partitionBy("source").orderBy(F.col("last_visited").isNotNull(), "depth", "last_visited", "node")
    able = nodes.where((F.col("active") == 1) & (F.col("exhausted") == 0) & (F.col("depth") <= most_depth))
    turn = able.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_visits).drop("place")
    done = turn.join(visits.select("source", "node", F.col("seen").alias("new_seen"), F.col("hits").alias("new_hits")), ["source", "node"], "left").na.fill(0, ["new_seen", "new_hits"])
    open_ = done.where(worth_expanding(F.col("kind"), F.col("seen"), F.col("hits")) & (F.col("depth") < most_depth))
    led = open_.select("source", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth")).join(edges.select("source", F.col("node").alias("parent"), F.col("neighbour").alias("node")), ["source", "parent"])
    fresh = led.join(nodes.select("source", "node"), ["source", "node"], "left_anti")
    found = fresh.groupBy("source", "node").agg(F.min("depth").alias("depth"), F.min_by("parent", F.struct("depth", "parent")).alias("parent"))
    return done, found


def run_frontier(nodes: DataFrame, visits: DataFrame, edges: DataFrame, budget: int, most_visits: int = MAX_VISITS, most_depth: int = MAX_DEPTH) -> tuple[DataFrame, list[dict[str, int]]]:
    """Rounds of visits until each source has spent its budget or has no node left to visit.

    ``nodes`` has source, node, kind, depth, active, exhausted, seen, hits, last_visited and
    parent; ``visits`` (source, node, seen, hits, exhausted) says what a visit yields, ``edges``
    (source, node, neighbour) where it leads. A round visits, per source, the first
    ``most_visits`` pending nodes that this run has not visited: never visited first, then
    shallow, then long ago, then by name. A node that the gate lets expand, by its counters
    before the visit, adds its unknown neighbours one deeper; of several parents the one
    visited first counts. A node without a visit yields and leads to nothing and costs its
    visit, as a failed one does.

    Returns the nodes, with ``turn`` (the round of the visit, from 1, or null), and per round
    its statistics: visited, candidates, hits, discovered. These are observed while the round
    is written; the next round reads what was written, so lineage stays short.
    """
    tables, stats, turn = Stored(nodes.sparkSession), [], 0
    columns = ["source", "node", "kind", "depth", "active", "exhausted", "seen", "hits", "last_visited", "parent", "turn"]
    state = tables.keep(nodes.withColumn("turn", F.lit(None).cast("int")).select(*columns), "0")
    order = Window.partitionBy("source").orderBy(F.col("last_visited").isNotNull(), "depth", "last_visited", "node")
    yields = visits.select("source", "node", F.col("seen").alias("new_seen"), F.col("hits").alias("new_hits"), F.col("exhausted").alias("now_exhausted"))
    while True:
        turn += 1
        able = state.where((F.col("active") == 1) & (F.col("exhausted") == 0) & (F.col("depth") <= most_depth) & F.col("turn").isNull())
        spent = state.where("turn IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("spent"))
        first = able.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(most_visits, budget))
        taken = first.join(spent, "source", "left").where(F.col("place") + F.coalesce("spent", F.lit(0)) <= budget).drop("spent")
        seen = Observation(f"visits {turn}")
        done = taken.join(yields, ["source", "node"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_seen", "new_hits")})
        done = done.observe(seen, F.count(F.lit(1)).alias("visited"), F.coalesce(F.sum("new_seen"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("new_hits"), F.lit(0)).alias("hits"))
        done = tables.keep(done, f"visits{turn}")
        counted = seen.get
        if not counted["visited"]:
            return state, stats
        leading = done.where("now_exhausted IS NOT NULL").where(worth_expanding(F.col("kind"), F.col("seen"), F.col("hits")) & (F.col("depth") < most_depth))
        led = leading.select("source", F.col("node").alias("parent"), "depth", "place").join(edges.select("source", F.col("node").alias("parent"), F.col("neighbour").alias("node")), ["source", "parent"])
        found = led.groupBy("source", "node").agg(F.min_by(F.struct((F.col("depth") + 1).alias("depth"), "parent"), "place").alias("by"))
        fresh = found.join(state.select("source", "node"), ["source", "node"], "left_anti").select(
            "source", "node", F.lit("discovered").alias("kind"), F.col("by.depth").alias("depth"), F.lit(1).alias("active"), F.lit(0).alias("exhausted"),
            F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast(state.schema["last_visited"].dataType).alias("last_visited"), F.col("by.parent").alias("parent"), F.lit(None).cast("int").alias("turn"),
        )
        new = Observation(f"nodes {turn}")
        fresh = fresh.observe(new, F.count(F.lit(1)).alias("discovered"))
        marks = done.select("source", "node", "new_seen", "new_hits", "now_exhausted", F.lit(True).alias("now"))
        after = state.join(marks, ["source", "node"], "left").withColumns({
            "seen": F.col("seen") + F.coalesce("new_seen", F.lit(0)),
            "hits": F.col("hits") + F.coalesce("new_hits", F.lit(0)),
            "exhausted": F.coalesce("now_exhausted", "exhausted"),
            "turn": F.when(F.col("now"), F.lit(turn)).otherwise(F.col("turn")),
        })
        state = tables.keep(after.select(*columns).unionByName(fresh), str(turn))
        tables.drop(str(turn - 1), f"visits{turn}")
        stats.append({**counted, **new.get})
