"""Entities, the frontier and near-duplicates over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators import graph as G
from siltwork.operators.similarity import near_duplicates
from siltwork.plans.frames import CANDIDATES_SQL, candidates, table
from siltwork.plans.registry import query

MENTIONS_SQL = f"""{CANDIDATES_SQL}, m AS (
    SELECT doc_id AS arrival, 'person' AS kind, author AS name, author AS norm, CASE WHEN channel IN ('hackernews','reddit','github') THEN 'handle:' || channel || ':' || author END AS key,
           channel AS source, id AS candidate FROM c
    UNION ALL SELECT 1000000000 + page_id, 'company', h, regexp_replace(h, '[^a-z0-9]+', '', 'g'), CASE WHEN page_id % 3 <> 0 THEN 'domain:' || h END, 'page', 'p' || page_id
    FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM pages))"""

NODES_SQL = """n AS (
    SELECT event_type AS source, user_id AS node, CASE WHEN user_id % 10 = 0 THEN 'seed' ELSE 'discovered' END AS kind, user_id % 5 AS depth, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 END AS active,
           CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS exhausted, count(*) AS seen, count(*) FILTER (WHERE value > 150) AS hits, CASE WHEN user_id % 4 <> 0 THEN epoch_us(max(ts)) END AS last_visited
    FROM events GROUP BY event_type, user_id)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, keyed by their handle on three channels, and hosts, two of three keyed."""
    handle = F.when(F.col("channel").isin("hackernews", "reddit", "github"), F.concat_ws(":", F.lit("handle"), "channel", "author"))
    people = candidates(spark, sf_dir).select(F.col("doc_id").alias("arrival"), F.lit("person").alias("kind"), F.col("author").alias("name"), F.col("author").alias("norm"), handle.alias("key"), F.col("channel").alias("source"), F.col("id").alias("candidate"))
    host = T.host(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1000000000).alias("arrival"),
        F.lit("company").alias("kind"),
        host.alias("name"),
        F.regexp_replace(host, "[^a-z0-9]+", "").alias("norm"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("domain:"), host)).alias("key"),
        F.lit("page").alias("source"),
        F.concat(F.lit("p"), F.col("page_id")).alias("candidate"),
    )
    return people.unionByName(pages)


@query(f"""
    WITH {MENTIONS_SQL}, g AS (SELECT key, min(arrival) AS first_arrival, min_by(kind, arrival) AS kind, min_by(norm, arrival) AS norm FROM m WHERE key IS NOT NULL GROUP BY key),
    o AS (SELECT kind, norm, min_by(key, first_arrival) AS owner FROM g WHERE norm <> '' GROUP BY kind, norm),
    x AS (SELECT m.*, coalesce(m.key, o.owner, m.kind || ':' || m.norm) AS entity, coalesce(m.key, m.kind || ':' || m.norm) AS seed FROM m LEFT JOIN o ON m.kind = o.kind AND m.norm = o.norm)
    SELECT substr(sha256(min_by(seed, arrival)), 1, 32) AS entity_id, min_by(kind, arrival) AS kind, min_by(name, arrival) AS name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
           count(DISTINCT candidate) AS mentions, min(arrival) AS first_at, max(arrival) AS last_at, max_by(key IS NULL, arrival) AND max(arrival) > min(arrival) AS needs_review FROM x GROUP BY entity
""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_entities(mentions(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per kind of event and user, with what was seen there."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), "user_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 150).alias("hits"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("latest")
    ).select(
        "source",
        user.alias("node"),
        F.when(user % 10 == 0, "seed").otherwise("discovered").alias("kind"),
        (user % 5).alias("depth"),
        F.when(user % 7 == 0, 0).otherwise(1).alias("active"),
        F.when(user % 11 == 0, 1).otherwise(0).alias("exhausted"),
        "seen",
        "hits",
        F.when(user % 4 != 0, F.col("latest")).alias("last_visited"),
    )


@query(f"""
    WITH {NODES_SQL}, p AS (SELECT source, node, depth, row_number() OVER (PARTITION BY source ORDER BY last_visited IS NOT NULL, depth, last_visited NULLS FIRST, node) AS place
        FROM n WHERE active = 1 AND exhausted = 0 AND depth <= 3) SELECT source, node, depth, place FROM p WHERE place <= 50
""")
def frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pending(nodes(spark, sf_dir)).select("source", "node", "depth", "place")


@query(f"WITH {NODES_SQL} SELECT source, node, seen, hits, kind = 'seed' OR seen < 20 OR hits / seen::DOUBLE >= 0.02 AS worth FROM n")
def frontier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("source", "node", "seen", "hits", G.worth_expanding(F.col("kind"), F.col("seen"), F.col("hits")).alias("worth"))


@query(f"""
    WITH {NODES_SQL}, p AS (SELECT source, node, hits, round(hits / seen::DOUBLE, 9) AS hit_rate, row_number() OVER (PARTITION BY source ORDER BY hits / seen::DOUBLE DESC, hits DESC, node) AS place
        FROM n WHERE kind = 'discovered' AND active = 1 AND seen > 0) SELECT source, node, hits, hit_rate, place FROM p WHERE place <= 20
""")
def frontier_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suggestions(nodes(spark, sf_dir)).select("source", "node", "hits", F.round("hit_rate", 9).alias("hit_rate"), "place")


@query("""
    SELECT node, count(DISTINCT user_id) AS authors FROM (SELECT user_id, event_type || strftime(ts, '-%d') AS node FROM events) a
    WHERE user_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND node NOT IN (SELECT DISTINCT event_type || strftime(ts, '-%d') FROM events WHERE day(ts) <= 10) GROUP BY node
""")
def coposting(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.concat("event_type", F.date_format("ts", "-dd")).alias("node"), F.dayofmonth("ts").alias("day"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("author"))
    return G.coposting(events.select("author", "node"), good, events.where("day <= 10").select("node").distinct())


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) + 1 AS dst FROM customer JOIN orders ON o_custkey = c_custkey),
    r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey % 100 = 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3),
    d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT d.node, d.depth, min(e.src) AS parent FROM d LEFT JOIN d p ON p.depth = d.depth - 1 LEFT JOIN e ON e.src = p.node AND e.dst = d.node WHERE d.depth = 0 OR e.src IS NOT NULL GROUP BY d.node, d.depth
""")
def frontier_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes within three steps of the seeds, over links between customers."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    n = customers.agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), "o_orderkey")
    edges = orders.join(customers, "src", "left_semi").crossJoin(F.broadcast(n)).select("src", (F.col("o_orderkey") % F.col("n") + 1).alias("dst")).distinct()
    return G.expand(edges, customers.where("src % 100 = 0").select(F.col("src").alias("node")))


@query()
def near_duplicate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that agree with the first of a shared band; signatures are beyond SQL."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


ROUND_SQL = f"""{NODES_SQL}, tv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_visited IS NOT NULL, depth, last_visited NULLS FIRST, node) AS place FROM n WHERE active = 1 AND exhausted = 0 AND depth <= 3) WHERE place <= 20),
    vi AS (SELECT tv.*, coalesce(e.s, 0) AS new_seen, coalesce(e.h, 0) AS new_hits FROM tv LEFT JOIN (SELECT event_type AS source, user_id AS node, count(*) AS s, count(*) FILTER (WHERE value > 180) AS h FROM events WHERE day(ts) > 25 GROUP BY 1, 2) e USING (source, node)),
    fd AS (SELECT vi.source, vi.depth + 1 AS depth, e.user_id + e.event_id % 40 AS node FROM vi JOIN events e ON e.event_type = vi.source AND e.user_id = vi.node WHERE vi.depth < 3 AND (vi.kind = 'seed' OR vi.seen < 20 OR vi.hits / vi.seen::DOUBLE >= 0.02)),
    nw AS (SELECT DISTINCT source, node FROM fd WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = fd.source AND n.node = fd.node))"""


@query(f"""
    WITH {ROUND_SQL} SELECT vi.source, count(*) AS visited, CAST(sum(new_seen) AS BIGINT) AS candidates, CAST(sum(new_hits) AS BIGINT) AS hits, max(coalesce(d.n, 0)) AS discovered FROM vi LEFT JOIN (SELECT source, count(*) AS n FROM nw GROUP BY source) d USING (source) GROUP BY vi.source
""")
def frontier_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one round of visits within a budget yields per source."""
    e = table(spark, sf_dir, "events")
    source, node = F.col("event_type").alias("source"), F.col("user_id").alias("node")
    visits = e.where("day(ts) > 25").groupBy(source, node).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 180).alias("hits"))
    edges = e.select(source, node, (F.col("user_id") + F.col("event_id") % 40).alias("neighbour"))
    done, found = G.expand_round(nodes(spark, sf_dir), visits, edges, most_visits=20)
    new = found.groupBy("source").agg(F.count(F.lit(1)).alias("discovered"))
    stats = done.groupBy("source").agg(F.count(F.lit(1)).alias("visited"), F.sum("new_seen").alias("candidates"), F.sum("new_hits").alias("hits"))
    return stats.join(new, "source", "left").na.fill(0, ["discovered"])


def linked_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as nodes of five sources, what a visit of each yields, and where its orders lead."""
    n_sources = 5
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % n_sources).cast("string").alias("source"), F.col("o_custkey").alias("node"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") % n_sources).cast("string").alias("source"), F.col("c_custkey").alias("node"))
    seeds = customers.where(F.expr("node div 5") % 40 == 0).select(
        "source", "node", F.lit("seed").alias("kind"), F.lit(0).alias("depth"), F.lit(1).alias("active"), F.lit(0).alias("exhausted"),
        F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("long").alias("last_visited"), F.lit(None).cast("long").alias("parent"),
    )
    count = customers.agg(F.count(F.lit(1)).alias("n"))
    yielded = orders.groupBy("source", "node").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("o_totalprice") > 150_000).alias("hits"))
    visits = yielded.withColumn("exhausted", (F.col("node") % 11 == 0).cast("int"))
    # An order leads to a customer of the same source.
    edges = orders.crossJoin(F.broadcast(count)).select("source", "node", ((F.col("o_orderkey") * 5 + F.col("source").cast("long")) % (F.expr("n div 5") * 5)).alias("neighbour")).distinct()
    return seeds, visits, edges


@query()
def frontier_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that five sources reach within a budget of visits each; rounds are beyond SQL."""
    found, _ = G.run_frontier(*linked_customers(spark, sf_dir), budget=400, most_visits=150)
    return found.select("source", "node", "kind", "depth", "exhausted", "seen", "hits", "parent", "turn")
