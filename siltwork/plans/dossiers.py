"""Dossiers over the driver tables: documents as evidence of 53 entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.operators import dossier as D
from siltwork.operators.entities import extract_mentions, resolve
from siltwork.functions import text as T
from siltwork.plans.frames import CANDIDATES_SQL, SIGNALS, candidates, table
from siltwork.plans.registry import query

EVIDENCE_SQL = f"""{CANDIDATES_SQL}, ev AS (SELECT 'e' || (doc_id % 53) AS entity, doc_id AS candidate, channel AS source, CASE WHEN doc_id % 6 <> 0 THEN node END AS node, CASE WHEN doc_id % 4 <> 0 THEN author END AS author, text,
    CASE WHEN doc_id % 2 = 0 THEN (doc_id * 7 % 101) / 100.0::DOUBLE END AS score, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 11 % 101) / 100.0::DOUBLE END AS similarity FROM c),
    pl AS (SELECT *, coalesce(score, similarity) AS worth, row_number() OVER (PARTITION BY entity ORDER BY coalesce(score, similarity) DESC NULLS LAST, candidate) AS place FROM ev)"""


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of entities, and the candidates behind it."""
    n = F.col("doc_id")
    c = candidates(spark, sf_dir).select(
        n.alias("candidate"), F.col("channel").alias("source"), F.when(n % 6 != 0, F.col("node")).alias("node"), F.when(n % 4 != 0, F.col("author")).alias("author"), "text", F.concat(F.lit("doc://"), n).alias("url"),
        F.when(n % 2 == 0, n * 7 % 101 / 100).alias("score"), F.when(n % 3 != 0, n * 11 % 101 / 100).alias("similarity"),
    )
    bridge = c.select(F.concat(F.lit("e"), F.col("candidate") % 53).alias("entity"), "candidate")
    return D.evidence_of(bridge, c), c


@query(f"WITH {EVIDENCE_SQL} SELECT entity, candidate, round(worth, 9) AS worth, place FROM pl")
def dossier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each entity, the best first, without a value last."""
    return evidence(spark, sf_dir)[0].select("entity", "candidate", F.round("worth", 9).alias("worth"), "place")


PATHS_SQL = f"""{EVIDENCE_SQL}, me AS (SELECT entity, min_by(author, candidate) AS me FROM ev WHERE author IS NOT NULL GROUP BY entity),
    nd AS (SELECT DISTINCT entity, source, node FROM ev WHERE node IS NOT NULL), au AS (SELECT DISTINCT source, node, author FROM ev WHERE author IS NOT NULL AND node IS NOT NULL),
    mt AS (SELECT nd.entity, nd.source, nd.node, au.author, row_number() OVER (PARTITION BY nd.entity, nd.source, nd.node ORDER BY au.author) AS n FROM nd JOIN me USING (entity) JOIN au ON nd.source = au.source AND nd.node = au.node AND au.author <> me.me
        WHERE nd.source IN ('whatsapp', 'reddit', 'substack', 'github')),
    pt AS (SELECT entity, source, author AS person, min(node) AS via FROM mt WHERE n <= 25 GROUP BY ALL),
    ps AS (SELECT *, CASE source WHEN 'whatsapp' THEN 1.0 WHEN 'github' THEN 0.6 WHEN 'reddit' THEN 0.35 ELSE 0.25 END::DOUBLE AS strength FROM pt),
    pr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, via, person) AS place FROM ps)"""


@query(f"""
    WITH {PATHS_SQL} SELECT entity, place, person, via, strength, CASE source WHEN 'whatsapp' THEN person || ' is in your ' || via || ' group' WHEN 'github' THEN person || ' appears in the ' || via || ' org'
        WHEN 'reddit' THEN person || ' also posts in r/' || via ELSE person || ' also writes in ' || via END AS words FROM pr WHERE place <= 10
""")
def warm_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest paths to each entity."""
    found = D.warm_paths(*evidence(spark, sf_dir))
    return found.select("entity", "place", "person", "via", "strength", D.describe_path(F.col("kind"), F.col("via"), F.col("person")).alias("words"))


@query(f"WITH {PATHS_SQL} SELECT ev.entity, max(me) AS author, coalesce(max(strength), 0.0) AS reachable FROM (SELECT DISTINCT entity FROM ev) ev LEFT JOIN me USING (entity) LEFT JOIN pr USING (entity) GROUP BY ev.entity")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each entity, with its author, can be reached."""
    found, c = evidence(spark, sf_dir)
    entities = found.select("entity").distinct()
    return D.reachability(entities, D.warm_paths(found, c)).join(D.author_of(found), "entity", "left").select("entity", "author", "reachable")


SIGNAL_ROWS_SQL = f"""{EVIDENCE_SQL}, sg AS (SELECT entity, candidate, place, source, text, unnest(['is_building','thesis_fit','founder_quality','timing','reachable','too_late']) AS signal, unnest([7, 11, 13, 17, 19, 23]) AS f FROM pl),
    sc AS (SELECT *, candidate * f % 101 / 100.0::DOUBLE AS score, CASE WHEN (candidate + f) % 4 = 0 THEN 'invented words' WHEN (candidate + f) % 4 = 1 THEN '' ELSE substr(text, 3, 20) END AS quote FROM sg),
    bs AS (SELECT entity, signal, max_by(struct_pack(score := score, quote := {"regexp_replace(regexp_replace(quote, '^\\s+', ''), '\\s+$', '')"}, source := source, candidate := candidate, text := text), (score, -place)) AS b FROM sc GROUP BY entity, signal),
    bq AS (SELECT entity, signal, b.score AS score, b.source AS source, b.candidate AS candidate, b.quote AS quote, trim(b.quote) <> '' AND contains(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.quote), '\\s+', ' ', 'g'))) AS real FROM bs)"""


def verdict_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence(spark, sf_dir)[0]
    n = F.col("candidate")

    def signal(f: int) -> F.Column:
        quote = F.when((n + f) % 4 == 0, "invented words").when((n + f) % 4 == 1, "").otherwise(F.substring("text", 3, 20))
        return F.struct((n * f % 101 / 100).alias("score"), quote.alias("quote"))

    return found.withColumns({name: signal(f) for name, f in SIGNALS})


@query(f"WITH {SIGNAL_ROWS_SQL} SELECT entity, signal, score, CASE WHEN real THEN quote ELSE '' END AS quote, quote <> '' AND NOT real AS fabricated, source, 'doc://' || candidate AS url FROM bq")
def entity_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each entity the best score of each signal with its quote, blanked where the text has it not."""
    return D.best_signals(verdict_evidence(spark, sf_dir), [name for name, _ in SIGNALS])


@query(f"""
    WITH {SIGNAL_ROWS_SQL}, w(thesis, ord, signal, weight) AS (VALUES ('first', 0, 'is_building', 0.5), ('first', 0, 'thesis_fit', 0.5), ('first', 0, 'too_late', -0.4), ('second', 1, 'founder_quality', 0.6), ('second', 1, 'timing', 0.4), ('third', 2, 'founder_quality', 0.6), ('third', 2, 'timing', 0.4)),
    cp(source, penalty) AS (VALUES ('whatsapp', 0.0933), ('inbound', 0.157)), sr AS (SELECT entity, count(DISTINCT source) AS sources, CASE WHEN count(*) FILTER (WHERE source = 'whatsapp') > 0 THEN 0.1 ELSE 0.2 END::DOUBLE AS penalty FROM ev GROUP BY entity),
    th AS (SELECT entity, thesis, ord, greatest(0.0, least(1.0, sum(score * weight) / sum(greatest(weight, 0.0)))) AS base FROM bq JOIN w USING (signal) GROUP BY ALL),
    fi AS (SELECT entity, thesis, ord, round(round(greatest(0.0, least(1.0, base * CASE WHEN sources = 2 THEN 1.12 WHEN sources = 3 THEN 1.2 WHEN sources > 3 THEN 1.25 ELSE 1.0 END) - penalty)::DOUBLE, 9), 4) AS score FROM th JOIN sr USING (entity))
    SELECT entity, max_by(thesis, (score, -ord)) AS thesis, max(score) AS score FROM fi GROUP BY entity
""")
def entity_best_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thesis that scores each entity best; of equal ones the first."""
    rows = verdict_evidence(spark, sf_dir)
    best = D.best_signals(rows, [name for name, _ in SIGNALS])
    penalty = F.when(F.count_if(F.col("source") == "whatsapp") > 0, 0.1).otherwise(0.2)
    sources = rows.groupBy("entity").agg(F.count_distinct("source").alias("sources"), penalty.alias("penalty"))
    given = [("first", 0, "is_building", 0.5), ("first", 0, "thesis_fit", 0.5), ("first", 0, "too_late", -0.4)] + [(t, o, s, w) for t, o in (("second", 1), ("third", 2)) for s, w in (("founder_quality", 0.6), ("timing", 0.4))]
    return D.score_theses(best, sources, spark.createDataFrame(given, "thesis string, ord int, signal string, weight double"))


@query(f"""
    WITH {CANDIDATES_SQL}, k AS (SELECT doc_id, id, channel, author, doc_id % 6 AS x FROM c),
    m AS (SELECT doc_id, id, 'company' AS kind, 'org' || (doc_id % 40) AS name, 'github' AS key, 'org' || (doc_id % 40) AS value FROM k WHERE channel = 'github' AND x IN (1, 5)
        UNION ALL SELECT doc_id, id, 'company', 'firm' || (doc_id % 30) || '.io', 'domain', 'firm' || (doc_id % 30) || '.io' FROM k WHERE x IN (0, 1)
        UNION ALL SELECT doc_id, id, 'person', 'ann-' || (doc_id % 20), 'linkedin', 'ann-' || (doc_id % 20) FROM k WHERE x = 2
        UNION ALL SELECT doc_id, id, 'company', 'acme' || (doc_id % 10), 'linkedin', 'acme' || (doc_id % 10) FROM k WHERE x = 3
        UNION ALL SELECT doc_id, id, 'person', author, 'handle', channel || ':' || lower(author) FROM k WHERE channel IN ('hackernews', 'reddit', 'whatsapp'))
    SELECT doc_id, kind, name, key, value FROM m
""")
def mention_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions out of titles, links and authors."""
    return mentions_of(spark, sf_dir).select(F.col("arrival").alias("doc_id"), "kind", "name", F.explode(F.create_map(*[c for k in ("domain", "github", "linkedin", "handle") for c in (F.lit(k), F.col(k))])).alias("key", "value")).where("value IS NOT NULL")


def mentions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    links = F.when(n % 6 < 2, F.concat(F.lit("see (https://www.Firm"), n % 30, F.lit(".io/about). More"))).when(n % 6 == 2, F.concat(F.lit("https://www.linkedin.com/in/Ann-"), n % 20, F.lit("/ x")))
    links = links.when(n % 6 == 3, F.concat(F.lit("https://linkedin.com/company/acme"), n % 10)).when(n % 6 == 4, "https://medium.com/x https://y.vercel.app").otherwise(F.lit(""))
    title = F.when(n % 2 == 1, F.concat(F.lit("Org"), n % 40, F.lit("/repo"))).otherwise(F.lit("a title"))
    title = F.when(n % 6 == 3, F.lit("x")).otherwise(title)
    c = candidates(spark, sf_dir).select(n.alias("arrival"), "id", F.col("channel").alias("source"), title.alias("title"), F.concat(F.substring("text", 1, 50), F.lit(" "), links).alias("raw_text"), "author")
    found = extract_mentions(c)
    return found.withColumn("name", F.when(F.col("kind") == "company", F.lower("name")).otherwise(F.col("name")))


@query("""
    WITH p AS (SELECT page_id, page_id % 17 AS g FROM pages)
    SELECT CAST(g AS BIGINT) AS first_page, count(*) * 3 AS mentions FROM p GROUP BY g
""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with a domain, an account and both: the one with both binds the other two."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 17).alias("g"))
    domain, github = F.concat(F.lit("d"), "g", F.lit(".io")), F.concat(F.lit("gh"), "g")
    null = F.lit(None).cast("string")
    parts = [(0, domain, null), (1, domain, github), (2, null, github)]
    rows = None
    for turn, d, g in parts:
        one = p.select(
            (F.col("page_id") * 10 + turn).alias("arrival"), F.lit("company").alias("kind"), F.concat(F.lit("Firm"), "page_id", F.lit(f"-{turn}")).alias("name"), F.concat(F.lit("firm"), "page_id", F.lit(f"t{turn}")).alias("norm"),
            d.alias("domain"), g.alias("github"), null.alias("linkedin"), null.alias("handle"), F.lit("page").alias("source"), F.concat(F.lit("c"), "page_id", F.lit(f"-{turn}")).alias("candidate"),
        )
        rows = one if rows is None else rows.unionByName(one)
    found = resolve(rows)
    return found.select((F.col("first_at") / 10).cast("long").alias("first_page"), "mentions")
