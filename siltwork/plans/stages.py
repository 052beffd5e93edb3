"""Stages of screening over the driver tables: vectors, verdicts, reports, nodes, erasure, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators import stages as G
from siltwork.operators.tables import new_rows
from siltwork.plans.frames import CANDIDATES_SQL, DAY, NOW_SECONDS, SIGNALS, candidates, table, thesis_vectors
from siltwork.plans.graph import NODES_SQL, nodes
from siltwork.plans.registry import query

NAMES = [name for name, _ in SIGNALS]
#: Terms that the five theses exclude; the tables' prose has these words.
EXCLUDES = ((0, ("the",)), (1, ("der", "clown")), (2, ("con",)), (3, ()), (4, ("a",)))


def excludes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(terms)) for k, terms in EXCLUDES], "thesis long, terms array<string>")


@query("""
    WITH t AS (SELECT vec_id AS phrasing, vec_id // 2 AS thesis, CAST(embedding AS DOUBLE[]) AS tv FROM embeddings WHERE vec_id < 10),
    d AS (SELECT doc_id, lower(text) AS low, CAST(embedding AS DOUBLE[]) AS ev FROM documents JOIN embeddings ON vec_id = doc_id),
    s AS (SELECT doc_id, thesis, max(round(list_cosine_similarity(ev, tv), 6)) AS cosine FROM d, t WHERE NOT ((thesis = 0 AND contains(low, 'the')) OR (thesis = 1 AND (contains(low, 'der') OR contains(low, 'clown'))) OR (thesis = 2 AND contains(low, 'con')) OR (thesis >= 3 AND contains(low, 'a'))) GROUP BY ALL)
    SELECT d.doc_id, coalesce(max(cosine), -1.0) AS similarity, max_by(thesis, (cosine, -thesis)) AS thesis FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
""")
def score_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best thesis that does not exclude a text; -1 and none where all do."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(e.select("doc_id"), "doc_id")
    phrasings = thesis_vectors(spark, sf_dir)
    found = G.cosines(e, "doc_id", "embedding", phrasings.select(F.col("phrasing").alias("query"), "vector"))
    scored = found.select("doc_id", F.expr("query div 2").alias("thesis"), F.expr("query div 2").alias("ord"), F.round("cosine", 6).alias("cosine"))
    barred = excludes(spark).withColumn("terms", F.when(F.col("thesis") >= 3, F.array(F.lit("a"))).otherwise(F.col("terms")))
    return G.best_allowed(scored, texts, "doc_id", barred)


@query("""
    WITH t AS (SELECT vec_id AS phrasing, CAST(embedding AS DOUBLE[]) AS tv FROM embeddings WHERE vec_id < 10), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings WHERE label % 3 = 1)
    SELECT vec_id, max(round(list_cosine_similarity(ev, tv), 6)) AS similarity, min_by(phrasing, (-round(list_cosine_similarity(ev, tv), 6), phrasing)) // 2 AS thesis FROM e, t GROUP BY vec_id
""")
def rescore_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities from stored vectors of the current model only, without asking it again."""
    model = F.when(F.col("label") % 3 != 0, F.concat(F.lit("m"), F.col("label") % 3))
    e = table(spark, sf_dir, "embeddings").where(model.eqNullSafe(F.lit("m1"))).select("vec_id", "embedding")
    found = G.cosines(e, "vec_id", "embedding", thesis_vectors(spark, sf_dir).select(F.col("phrasing").alias("query"), "vector")).withColumn("cosine", F.round("cosine", 6))
    return found.groupBy("vec_id").agg(F.max("cosine").alias("similarity"), F.expr("max_by(query, struct(cosine, -query)) div 2").alias("thesis"))


@query("""
    SELECT vec_id AS id FROM embeddings JOIN documents ON doc_id = vec_id WHERE (vec_id % 4 = 0 OR CASE WHEN label % 3 = 0 THEN NULL ELSE 'm' || (label % 3) END IS DISTINCT FROM 'm1') AND vec_id % 5 <> 0 AND source NOT IN (SELECT min(source) FROM documents)
""")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfiltered rows without a vector of the hosted model; those of a private source are not sent."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    private = d.agg(F.min("source").alias("private"))
    c = d.join(e, "id").crossJoin(F.broadcast(private)).select(
        "id", F.when(F.col("source") == F.col("private"), "whatsapp").otherwise(F.col("source")).alias("source"), F.when(F.col("id") % 4 != 0, F.col("embedding")).alias("embedding"),
        F.when(F.col("label") % 3 != 0, F.concat(F.lit("m"), F.col("label") % 3)).alias("embedding_model"), F.when(F.col("id") % 5 == 0, "too_short").alias("filtered_reason"),
    )
    return G.pending_vectors(c, "m1", local=False).select("id")


@query("SELECT doc_id, length(trim(text)) > 0 AS asked FROM documents WHERE trim(coalesce(text, '')) <> ''")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded by a model of hashed words, 64 at a time."""
    found = G.embed(table(spark, sf_dir, "documents"), "doc_id", "text", G.hashed_words())
    return found.select("doc_id", (F.size("embedding") == 64).alias("asked"))


def canned(text: str, thesis: str) -> str:
    """A judge without a model: its answer depends on the text's length."""
    n = len(text)
    if n % 7 == 0:
        return "Sorry, {no answer"
    quote = text[3:23].replace("\\", "").replace('"', "") if n % 2 else "made up words"
    quote = "".join(c for c in quote if c >= " ")
    return f'Sure! ```json\n{{"is_building": {{"score": 0.{n % 10}, "quote": "{quote}"}}, "timing": {{"score": 0.5}}, "stage": "seed {{x}}"}}\n``` done'


@query("""
    SELECT doc_id, length(text) % 7 = 0 AS failed, CASE WHEN length(text) % 7 = 0 THEN 0.0 ELSE (length(text) % 10) / 10.0::DOUBLE END AS is_building, CASE WHEN length(text) % 7 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS timing, 0.0::DOUBLE AS reachable,
        CASE WHEN length(text) % 7 <> 0 AND length(text) % 10 >= 5 THEN 1 ELSE 0 END AS is_startup, CASE WHEN length(text) % 7 <> 0 THEN 'seed {x}' END AS stage, CASE WHEN doc_id % 3 = 0 THEN 0.4 WHEN length(text) % 7 <> 0 THEN 0.7 END::DOUBLE AS match FROM documents
""")
def triage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers asked for inside the tasks, their scores, stage and match; broken ones are marked."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("thesis").alias("thesis"))
    found = G.triage(rows, "doc_id", canned)
    answer = F.col("answer")
    v = G.verdict_columns(answer, NAMES)
    match = G.thesis_match(F.when(F.col("doc_id") % 3 == 0, '{"thesis_match": "0.4"}').otherwise(answer), F.lit(0.7))
    return found.select("doc_id", F.col("error").isNotNull().alias("failed"), v["is_building"].alias("is_building"), v["timing"].alias("timing"), v["reachable"].alias("reachable"), F.coalesce(v["is_startup"], F.lit(0)).alias("is_startup"), v["stage"].alias("stage"), match.alias("match"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(substr(text, 3, 20), '\\s+', ' ', 'g')) <> '' ELSE false END AS kept_quote, doc_id % 101 / 100.0::DOUBLE AS score FROM documents
""")
def verdict_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented quotes blanked inside the verdict; its score stays."""
    n, text = F.col("doc_id"), F.col("text")
    quote = F.when(n % 2 == 0, F.substring(text, 3, 20)).otherwise("an invented quote ~")
    answer = F.to_json(F.struct(F.struct((n % 101 / 100).alias("score"), quote.alias("quote")).alias("is_building"), F.lit("seed").alias("stage")))
    checked = table(spark, sf_dir, "documents").select("doc_id", F.from_json(G.quotes_checked(answer, text, NAMES), "is_building struct<score:double,quote:string>").alias("v"))
    return checked.select("doc_id", (F.trim(F.coalesce("v.is_building.quote", F.lit(""))) != "").alias("kept_quote"), F.col("v.is_building.score").alias("score"))


@query("""
    WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'Nowhere ~ City' ELSE substr(text, 2, 30) END AS place, CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE 'https://' || substr(text, 1, 12) END AS site FROM documents),
    k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(place), '^\\s+', ''), '\\s+$', ''), '^https?://|/$', '', 'g') AS p1, regexp_replace(regexp_replace(regexp_replace(lower(site), '^\\s+', ''), '\\s+$', ''), '^https?://|/$', '', 'g') AS s1, regexp_replace(lower(text), '^https?://', '') AS hay FROM d),
    g AS (SELECT *, p1 IN ('', 'unknown', 'n/a', 'none', 'yes', 'no', 'y', 'n') OR contains(hay, substr(p1, 1, 40)) AS pok, s1 IN ('', 'unknown', 'n/a', 'none', 'yes', 'no', 'y', 'n') OR contains(hay, substr(s1, 1, 40)) AS sok FROM k)
    SELECT doc_id, CASE WHEN pok THEN place ELSE 'unknown' END AS place, CASE WHEN sok THEN site ELSE 'unknown' END AS site, 'not checked' AS view, concat_ws(',', CASE WHEN NOT pok THEN 'based_in' END, CASE WHEN NOT sok THEN 'website' END) AS removed FROM g
""")
def report_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without factual fields that their text does not support, and what went."""
    n, text = F.col("doc_id"), F.col("text")
    place = F.when(n % 3 == 0, "Nowhere ~ City").otherwise(F.substring(text, 2, 30))
    site = F.when(n % 4 == 0, "n/a").otherwise(F.concat(F.lit("https://"), F.substring(text, 1, 12)))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.create_map(F.lit("based_in"), place, F.lit("website"), site, F.lit("your_view"), F.lit("not checked")).alias("report"))
    clean, removed = G.ground_report(F.col("report"), text, ("based_in", "website"))
    return d.select("doc_id", clean.alias("r"), removed.alias("removed")).select("doc_id", F.col("r")["based_in"].alias("place"), F.col("r")["website"].alias("site"), F.col("r")["your_view"].alias("view"), F.array_join("removed", ",").alias("removed"))


@query(f"""
    WITH {CANDIDATES_SQL}, k AS (SELECT *, contains(lower(text), 'the') AS a, contains(lower(text), 'der') AS b FROM c), s AS (SELECT * FROM k WHERE NOT (a AND b) AND doc_id % 5 <> 0)
    SELECT channel, count(*) AS added FROM s GROUP BY channel
""")
def store_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows per channel, without those that every thesis excludes."""
    c = candidates(spark, sf_dir)
    theses = (("the",), ("der",))
    able = c.where(~(T.any_term(F.col("text"), theses[0]) & T.any_term(F.col("text"), theses[1])))
    return new_rows(able, c.where("doc_id % 5 = 0"), "id", "doc_id").groupBy("channel").agg(F.count(F.lit(1)).alias("added"))


@query("SELECT doc_id, array_to_string(list_filter(['the', 'und', 'zzz'], lambda x: NOT contains(lower(text), x)), ',') AS missing FROM documents")
def must_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a thesis asks for and a text lacks."""
    terms = F.array(F.lit("the"), F.lit("UND"), F.lit("zzz"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.array_join(G.missing_terms(F.col("text"), terms), ",")).alias("missing"))


@query(f"""
    WITH {NODES_SQL}, v AS (SELECT event_type AS source, user_id AS node, count(*) AS s, count(*) FILTER (WHERE value > 180) AS h FROM events WHERE day(ts) > 20 GROUP BY 1, 2)
    SELECT n.source, n.node, n.seen + coalesce(v.s, 0) AS seen, n.hits + coalesce(v.h, 0) AS hits, CASE WHEN v.s IS NULL THEN n.exhausted ELSE 1 END AS exhausted, n.kind = 'seed' OR n.seen < 20 OR n.hits / n.seen::DOUBLE >= 0.02 AS gate FROM n LEFT JOIN v USING (source, node)
""")
def visit_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after a round of visits, and the gate, which looks at the counters before it."""
    from siltwork.operators.graph import worth_expanding

    n = nodes(spark, sf_dir)
    e = table(spark, sf_dir, "events").where("day(ts) > 20")
    visits = e.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 180).alias("hits"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("at"), F.lit(1).alias("exhausted"))
    gate = n.select("source", "node", worth_expanding(F.col("kind"), F.col("seen"), F.col("hits")).alias("gate"))
    return G.record_visits(n, visits).join(gate, ["source", "node"]).select("source", "node", "seen", "hits", "exhausted", "gate")


@query(f"""
    WITH {NODES_SQL}, f AS (SELECT event_type AS source, user_id AS parent, user_id + event_id % 40 AS node FROM events), a AS (SELECT f.source, f.node, n.depth + 1 AS depth, f.parent FROM f JOIN n ON n.source = f.source AND n.node = f.parent WHERE NOT EXISTS (SELECT 1 FROM n k WHERE k.source = f.source AND k.node = f.node))
    SELECT source, node, min(depth) AS depth, min_by(parent, (depth, parent)) AS parent FROM a GROUP BY source, node
""")
def frontier_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that others led to, one deeper; known ones, rejected or not, are not added again."""
    n = nodes(spark, sf_dir).select("source", "node", "depth")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("parent"), (F.col("user_id") + F.col("event_id") % 40).alias("node"))
    return G.add_nodes(n, e)


@query(f"WITH {NODES_SQL} SELECT count(*) AS nodes, CAST(sum(CASE WHEN node % 13 = 0 THEN 0 ELSE active END) AS BIGINT) AS active, CAST(sum(exhausted) AS BIGINT) AS exhausted, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE last_visited IS NOT NULL) AS visited FROM n")
def frontier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the frontier after some nodes were turned off."""
    n = nodes(spark, sf_dir)
    off = G.deactivate(n, n.where("node % 13 = 0").select("source", "node"))
    return off.agg(F.count(F.lit(1)).alias("nodes"), F.sum("active").alias("active"), F.sum("exhausted").alias("exhausted"), F.sum("seen").alias("seen"), F.sum("hits").alias("hits"), F.count("last_visited").alias("visited"))


@query(f"WITH {NODES_SQL}, p AS (SELECT source, node, hits, seen, row_number() OVER (ORDER BY hits DESC, seen DESC, source, node) AS place FROM n) SELECT * FROM p WHERE place <= 30")
def node_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty nodes of most hits, then most rows."""
    from pyspark.sql import Window

    order = [F.desc("hits"), F.desc("seen"), F.col("source"), F.col("node")]
    best = nodes(spark, sf_dir).select("source", "node", "hits", "seen").orderBy(*order).limit(30)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query(f"""
    WITH {CANDIDATES_SQL}, gone AS (SELECT doc_id FROM c WHERE author = 'u7'), en AS (SELECT 'n' || (doc_id % 97) AS entity, doc_id FROM documents)
    SELECT (SELECT count(*) FROM c WHERE author <> 'u7') AS candidates, (SELECT count(*) FROM conversations WHERE role || (conv_id % 9) <> 'user7') AS messages, (SELECT count(*) FROM events WHERE user_id <> 7) AS activity,
        (SELECT count(*) FROM customer WHERE c_custkey % 97 <> 7) AS nodes, (SELECT count(*) FROM customer WHERE c_custkey % 97 <> 7 AND c_custkey % 5 <> 0) AS parents, 97 - 3 AS entities,
        (SELECT count(*) FROM documents WHERE doc_id % 97 NOT IN (7, 20, 30)) AS evidence, (SELECT count(*) FROM documents WHERE doc_id % 97 <> 7 AND (doc_id + 1) % 97 <> 7) AS duplicates
""")
def erase_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of seven tables after one person is erased from all of them."""
    n = F.col("doc_id")
    c = candidates(spark, sf_dir).select(n.alias("id"), "author")
    kept = G.erase_author({
        "candidates": c,
        "messages": table(spark, sf_dir, "conversations").select(F.when(F.concat("role", F.col("conv_id") % 9) == "user7", "u7").otherwise("x").alias("sender")),
        "activity": table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("author")),
        "nodes": table(spark, sf_dir, "customer").select(F.lit("s").alias("source"), F.concat(F.lit("u"), F.col("c_custkey") % 97).alias("node"), F.lit(None).cast("string").alias("display_name"), F.when(F.col("c_custkey") % 5 == 0, "u7").otherwise("root").alias("parent")),
        "entities": spark.range(97).select(F.concat(F.lit("n"), "id").alias("entity"), F.when(F.col("id") == 20, "U7").otherwise(F.concat(F.lit("u"), "id")).alias("name"), F.when(F.col("id") == 20, "u7").otherwise(F.concat(F.lit("u"), "id")).alias("norm_name"), F.when(F.col("id") == 30, "reddit:U7").when(F.col("id") == 31, "reddit:xu7").alias("handle")),
        "evidence": table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), n % 97).alias("entity"), n.alias("candidate")),
        "duplicates": c.select("id", (F.col("id") + 1).alias("duplicate_of")),
    }, "u7")
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, rows in kept.items()]
    counts.append(kept["nodes"].agg(F.count("parent").alias("n")).withColumn("name", F.lit("parents")))
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out.groupBy().pivot("name", [*kept, "parents"]).agg(F.first("n"))


@query("""
    SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'too_short' WHEN doc_id % 3 = 0 THEN 'duplicate: ' || printf('%.2f', 0.7 + (doc_id % 30) / 100.0) || ' similar to ' || substr(sha256(CAST(doc_id - 1 AS VARCHAR)), 1, 12) END AS reason FROM documents
""")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason of near-duplicates, written only where there is none yet."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(n.alias("id"), F.when(n % 4 == 0, "too_short").alias("filtered_reason"))
    found = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(n.alias("id"), F.sha2((n - 1).cast("string"), 256).alias("duplicate_of"), (0.7 + n % 30 / 100).alias("similarity"))
    return G.mark_duplicates(d, found).select("id", F.col("filtered_reason").alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN false ELSE ts < TIMESTAMP '2024-01-16 00:00:00' END AS expired, strftime(ts + INTERVAL 365 DAY, '%Y-%m-%d') AS until FROM events")
def retention_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past fifteen days by an ISO time, unreadable ones never; and the day a year on."""
    updated = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, sf_dir, "events").select("event_id", G.expired(updated, 1706659200, 15).alias("expired"), F.date_format(F.col("ts") + F.expr("INTERVAL 365 DAYS"), "yyyy-MM-dd").alias("until"))


@query("SELECT doc_id AS id, doc_id * 11 % 101 / 100.0::DOUBLE AS similarity FROM documents WHERE doc_id * 11 % 101 / 100.0 >= 0.35 ORDER BY similarity DESC, id LIMIT 50")
def gate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best from the global threshold on."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 11 % 101 / 100).alias("similarity"))
    return G.survivors(c, 0.35, 50)


@query("""
    WITH t(thesis, ord) AS (VALUES (0, 0), (1, 1), (2, 2)), d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id % 5 END AS thesis, doc_id * 11 % 101 / 100.0::DOUBLE AS similarity FROM documents), r AS (SELECT doc_id, similarity, coalesce(t.thesis, 0) AS thesis FROM d LEFT JOIN t USING (thesis))
    SELECT t.thesis, count(r.doc_id) AS claimed, max(similarity) AS best FROM t LEFT JOIN r USING (thesis) GROUP BY t.thesis
""")
def thesis_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and best similarity of each thesis; rows of an unknown thesis count for the first."""
    theses = spark.range(3).select(F.col("id").cast("int").alias("thesis"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 4, F.col("doc_id") % 5).alias("thesis"), (F.col("doc_id") * 11 % 101 / 100).alias("similarity"))
    first = theses.agg(F.min("thesis").alias("first"))
    known = d.join(F.broadcast(theses.withColumn("known", F.lit(True))), "thesis", "left").crossJoin(F.broadcast(first)).withColumn("thesis", F.when(F.col("known"), F.col("thesis").cast("int")).otherwise(F.col("first")))
    return theses.join(known.groupBy("thesis").agg(F.count(F.lit(1)).alias("claimed"), F.max("similarity").alias("best")), "thesis", "left").select("thesis", F.coalesce("claimed", F.lit(0)).alias("claimed"), "best")


@query("""
    WITH r AS (SELECT event_type AS arm, value, CASE WHEN event_id % 10 < 4 THEN 'unknown' WHEN event_id % 10 = 4 THEN '' ELSE 'x' END AS answer, event_id % 6 = 0 AS invented FROM events)
    SELECT arm, round(count(*) FILTER (WHERE answer NOT IN ('', 'unknown', 'n/a')) / count(*)::DOUBLE, 9) AS filled, round(count(*) FILTER (WHERE invented AND answer = 'x') / nullif(count(*) FILTER (WHERE answer = 'x'), 0)::DOUBLE, 9) AS invented, round(avg(value), 6) AS latency FROM r GROUP BY arm
""")
def prompt_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each arm of a trial the share of filled and of invented answers, and the mean latency."""
    kind = F.col("event_id") % 10
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), "value", F.when(kind < 4, "unknown").when(kind == 4, "").otherwise("x").alias("answer"), (F.col("event_id") % 6 == 0).alias("invented"))
    filled = ~F.col("answer").isin("", "unknown", "n/a")
    return r.groupBy("arm").agg(F.round(F.count_if(filled) / F.count(F.lit(1)), 9).alias("filled"), F.round(F.try_divide(F.count_if(filled & F.col("invented")), F.count_if(filled)), 9).alias("invented"), F.round(F.avg("value"), 6).alias("latency"))


@query("""
    SELECT id, seed FROM (SELECT DISTINCT 'p-' || (doc_id % 40) AS id, 'linkedin' AS seed FROM documents WHERE doc_id * 7 % 101 / 100.0 > 0.5 ORDER BY id LIMIT 20)
    UNION ALL SELECT DISTINCT 'folder' || (conv_id % 12), 'inbound' FROM conversations
""")
def collector_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where collectors begin: twenty profiles that scored well elsewhere, and the folders of an inbox."""
    good = table(spark, sf_dir, "documents").where("doc_id * 7 % 101 / 100 > 0.5").select(F.concat(F.lit("p-"), F.col("doc_id") % 40).alias("id")).distinct().orderBy("id").limit(20)
    folders = table(spark, sf_dir, "conversations").select(F.concat(F.lit("folder"), F.col("conv_id") % 12).alias("id")).distinct()
    return good.withColumn("seed", F.lit("linkedin")).unionByName(folders.withColumn("seed", F.lit("inbound")))


@query(f"""
    WITH {CANDIDATES_SQL}, f AS (SELECT doc_id, (doc_id * 7 % 101) / 100.0::DOUBLE AS sc, (doc_id * 11 % 101) / 100.0::DOUBLE AS sim FROM c), o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN sim ELSE sc END DESC, doc_id) AS n FROM f),
    p AS (SELECT doc_id, 1 / (1 + exp(-(ln(0.02 / 0.98) + (coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sc END, 0), sim) - 0.5) * 7.2))) AS p FROM o WHERE n <= 100),
    g AS (SELECT i, -7.5 + i * 0.075 AS x, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(201) t(i)),
    e AS (SELECT doc_id, p, sum(w * greatest(p * exp(-0.5 * (x - 0.75) * (x - 0.75)) * 30 - (1 - p) * exp(-0.5 * (x + 0.75) * (x + 0.75)), 0.0)) * 0.075 / 3 / sqrt(2 * pi()) AS total FROM p, g GROUP BY doc_id, p),
    v AS (SELECT doc_id, round(greatest(0.0, total - greatest(p * 30 - (1 - p), 0.0)) / 0.5, 7) AS priority FROM e), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, doc_id) AS place FROM v)
    SELECT place, doc_id, priority FROM r WHERE place <= 20
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty reviews that are worth most per cost, out of five times as many by score."""
    from pyspark.sql import Window

    from siltwork.functions import scores as S

    n = F.col("doc_id")
    c = candidates(spark, sf_dir).select("doc_id", F.when(n % 3 != 0, n * 7 % 101 / 100).alias("score"), (n * 11 % 101 / 100).alias("similarity"))
    able = c.orderBy(F.coalesce("score", "similarity").desc_nulls_last(), "doc_id").limit(100)
    p = S.posterior(F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), "similarity", F.lit(0.0)))
    valued = able.select("doc_id", F.round(S.evsi(p) / 0.5, 7).alias("priority"))
    return valued.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "doc_id"))).where("place <= 20").select("place", "doc_id", "priority")


@query(f"SELECT channel, count(*) AS n, min(days) AS youngest FROM (SELECT channel, (1789171200 - posted_s) // 86400 AS days, strftime(make_timestamp(posted_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM ({CANDIDATES_SQL.strip().removeprefix('c AS (').removesuffix(')')})) GROUP BY channel")
def posted_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in whole days of times that went through ISO texts and back."""
    iso = F.date_format(F.timestamp_seconds("posted_s"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    c = candidates(spark, sf_dir).select("channel", F.floor((F.lit(NOW_SECONDS) - F.unix_timestamp(F.try_to_timestamp(iso))) / DAY).alias("days"))
    return c.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("days").alias("youngest"))
