"""Scans, counts, joins, gates, merges and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.functions.scores import recency
from siltwork.operators.stages import cosines
from siltwork.operators.tables import fill_missing, first_by, nearest_rank, new_rows, purge, refresh_captures, top_share, upsert_last
from siltwork.plans.frames import CANDIDATES_SQL, DAY, NOW_SECONDS, SIMILARITY_SQL, candidates, table, thesis_vectors
from siltwork.plans.registry import query


def best_theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, similarity, thesis: the best phrasing of each vector, the lowest one on ties."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    phrasings = thesis_vectors(spark, sf_dir).select(F.col("phrasing").alias("query"), "vector")
    scored = cosines(vectors, "doc_id", "embedding", phrasings).select("doc_id", "query", F.round("cosine", 6).alias("cosine"))
    return scored.groupBy("doc_id").agg(F.max("cosine").alias("similarity"), F.expr("max_by(query, struct(cosine, -query)) div 2").alias("thesis"))


@query("""
    SELECT source, count(*) AS n_docs, count(text) AS n_texts, count(vec_id) AS n_embedded, count(quality) AS n_judged,
           CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_good, CAST(sum(length(text)) AS BIGINT) AS n_chars
    FROM documents LEFT JOIN embeddings ON vec_id = documents.doc_id LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY source
""")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each source by how far its documents came."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id")
    judged = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(embedded, "doc_id", "left").join(judged, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count("text").alias("n_texts"),
        F.count("vec_id").alias("n_embedded"),
        F.count("quality").alias("n_judged"),
        F.count_if(F.col("quality") == 1).alias("n_good"),
        F.sum(F.length("text").cast("long")).alias("n_chars"),
    )


@query(f"""
    WITH {CANDIDATES_SQL} SELECT k AS channel, coalesce(n, 0) AS n, last_s
    FROM unnest(['whatsapp','inbound','linkedin','reddit','substack','github','hackernews','telegram']) u(k)
    LEFT JOIN (SELECT channel, count(*) AS n, max(posted_s) AS last_s FROM c GROUP BY channel) g ON g.channel = k
""")
def channel_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known channel with its count, zero where nothing came."""
    known = spark.createDataFrame([(c,) for c in ("whatsapp", "inbound", "linkedin", "reddit", "substack", "github", "hackernews", "telegram")], "channel string")
    counts = candidates(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max("posted_s").alias("last_s"))
    return known.join(counts, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("n"), "last_s")


@query("""
    SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic,
           count(*) - CAST(sum(quality) AS BIGINT) AS bad, greatest(0, 100 - count(*)) AS to_target FROM labels
""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "labels").agg(n.alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), (n - F.sum("quality")).alias("bad"), F.greatest(F.lit(0), 100 - n).alias("to_target"))


@query("SELECT vec_id FROM embeddings WHERE CASE WHEN label % 3 = 0 THEN NULL ELSE 'm' || (label % 3) END IS DISTINCT FROM 'm1'")
def pending_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors not made by the current model, unknown models included."""
    model = F.when(F.col("label") % 3 != 0, F.concat(F.lit("m"), F.col("label") % 3))
    return table(spark, sf_dir, "embeddings").where(~model.eqNullSafe(F.lit("m1"))).select("vec_id")


@query(f"WITH {SIMILARITY_SQL} SELECT doc_id, similarity, thesis FROM s")
def best_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_theses(spark, sf_dir)


@query(f"""
    WITH {SIMILARITY_SQL}, able AS (
        SELECT d.doc_id, d.source, s.similarity, row_number() OVER (PARTITION BY d.source ORDER BY s.similarity DESC, d.doc_id) AS place,
               count(*) OVER (PARTITION BY d.source) AS n
        FROM documents d JOIN s USING (doc_id) WHERE s.similarity >= 0.25)
    SELECT doc_id, source, similarity, place FROM able WHERE place <= greatest(1, CAST(round_even(n * 0.1, 0) AS INTEGER))
""")
def gate_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tenth of each source above the floor."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(best_theses(spark, sf_dir), "doc_id")
    return top_share(joined, "source", "similarity", "doc_id", 0.1, 0.25).select("doc_id", "source", "similarity", "place")


@query(f"""
    WITH {SIMILARITY_SQL}, able AS (
        SELECT d.doc_id, d.source, s.similarity, row_number() OVER (PARTITION BY d.source ORDER BY s.similarity DESC, d.doc_id) AS place,
               count(*) OVER (PARTITION BY d.source) AS n
        FROM documents d JOIN s USING (doc_id) WHERE s.similarity >= 0.25),
    kept AS (SELECT min(similarity) AS cutoff FROM able WHERE place <= greatest(1, CAST(round_even(n * 0.1, 0) AS INTEGER)))
    SELECT cutoff, count(*) AS passing FROM s, kept WHERE similarity >= cutoff GROUP BY cutoff
""")
def gate_effective_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one threshold that the gate amounts to if applied to all sources, and what passes it."""
    cutoff = gate_per_source(spark, sf_dir).agg(F.min("similarity").alias("cutoff"))
    return best_theses(spark, sf_dir).join(F.broadcast(cutoff), F.col("similarity") >= F.col("cutoff")).groupBy("cutoff").agg(F.count(F.lit(1)).alias("passing"))


@query(f"""
    WITH {SIMILARITY_SQL}, r AS (
        SELECT d.source, s.similarity, row_number() OVER (PARTITION BY d.source ORDER BY s.similarity) - 1 AS pos, count(*) OVER (PARTITION BY d.source) AS n
        FROM documents d JOIN s USING (doc_id))
    SELECT source, max(similarity) FILTER (WHERE pos = least(n * 10 // 100, n - 1)) AS p10, max(similarity) FILTER (WHERE pos = least(n * 50 // 100, n - 1)) AS p50,
           max(similarity) FILTER (WHERE pos = least(n * 90 // 100, n - 1)) AS p90 FROM r GROUP BY source
""")
def percentiles_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(best_theses(spark, sf_dir), "doc_id")
    return nearest_rank(joined, ["source"], "similarity", (10, 50, 90))


@query(f"""
    WITH {CANDIDATES_SQL}, incoming AS (SELECT doc_id, id, 0 AS arrival FROM c UNION ALL SELECT doc_id + 5000000, sha256('doc://' || (doc_id - doc_id % 2)), doc_id + 1 FROM documents)
    SELECT id, min_by(doc_id, (arrival, doc_id)) AS doc_id, count(*) AS seen FROM incoming WHERE id NOT IN (SELECT id FROM c WHERE doc_id % 5 = 0) GROUP BY id
""")
def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore of a batch that repeats itself into a table that holds a fifth of it."""
    c = candidates(spark, sf_dir).select("doc_id", "id")
    again = c.select((F.col("doc_id") + 5000000).alias("doc_id"), F.sha2(F.concat(F.lit("doc://"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")), 256).alias("id"), (F.col("doc_id") + 1).alias("arrival"))
    incoming = c.withColumn("arrival", F.lit(0).cast("long")).unionByName(again)
    added = new_rows(incoming, c.where("doc_id % 5 = 0"), "id", "arrival", "doc_id")
    return added.join(incoming.groupBy("id").agg(F.count(F.lit(1)).alias("seen")), "id").select("id", "doc_id", "seen")


@query("""
    WITH old AS (SELECT doc_id AS a, 'old' || quality AS v FROM labels), new AS (SELECT doc_id + 1 AS a, 'new' || toxic AS v FROM labels)
    SELECT coalesce(new.a, old.a) AS id, coalesce(new.v, old.v) AS value FROM old FULL JOIN new ON old.a = new.a
""")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-replace: the incoming value wins."""
    labels = table(spark, sf_dir, "labels")
    old = labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("old"), F.col("quality")).alias("value"))
    new = labels.select((F.col("doc_id") + 1).alias("id"), F.concat(F.lit("new"), F.col("toxic")).alias("value"))
    return upsert_last(old, new, "id")


@query("""
    WITH old AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents),
         new AS (SELECT doc_id + 7 AS id, lang, source FROM documents)
    SELECT coalesce(old.id, new.id) AS id, coalesce(old.lang, new.lang) AS lang, coalesce(old.source, new.source) AS source FROM old FULL JOIN new ON old.id = new.id
""")
def fill_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coalescing update: what is known stays, gaps are filled."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END").alias("lang"), F.expr("CASE WHEN doc_id % 3 = 0 THEN source END").alias("source"))
    return fill_missing(old, docs.select((F.col("doc_id") + 7).alias("id"), "lang", "source"), "id", ["lang", "source"])


@query("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by day and provider, summed from the call log."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")
    )


@query(f"""
    WITH {CANDIDATES_SQL} SELECT channel, count(*) AS kept, count(*) FILTER (quality = 1) AS judged_good FROM c LEFT JOIN labels USING (doc_id)
    WHERE NOT posted_s < 1789171200 - 365 * 86400 GROUP BY channel
""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left a year on, with its judgements; those of purged rows go too."""
    kept, judged = purge(candidates(spark, sf_dir), F.col("posted_s") < NOW_SECONDS - 365 * DAY, table(spark, sf_dir, "labels"), "doc_id")
    return kept.join(judged, "doc_id", "left").groupBy("channel").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("quality") == 1).alias("judged_good"))


@query(f"""
    WITH {CANDIDATES_SQL}, gone AS (SELECT doc_id, node FROM c WHERE author = 'u7')
    SELECT (SELECT count(*) FROM gone) AS candidates, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM gone)) AS labels,
           (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM gone)) AS vectors,
           (SELECT count(*) FROM events WHERE user_id = 7) AS activity, (SELECT count(*) FROM c WHERE author <> 'u7') AS others
""")
def erase_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What erasing one author takes from each table, and what it leaves."""
    c = candidates(spark, sf_dir)
    gone = c.where("author = 'u7'").select("doc_id")
    parts = {
        "candidates": gone,
        "labels": table(spark, sf_dir, "labels").join(gone, "doc_id", "left_semi"),
        "vectors": table(spark, sf_dir, "embeddings").join(gone, F.col("vec_id") == F.col("doc_id"), "left_semi"),
        "activity": table(spark, sf_dir, "events").where("user_id = 7"),
        "others": c.where("author <> 'u7'"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query(f"""
    WITH {CANDIDATES_SQL} SELECT doc_id, CASE WHEN channel IN ('whatsapp') THEN '[private]' ELSE substr(text, 1, 200) END AS text,
           CASE WHEN channel IN ('whatsapp') THEN NULL ELSE title END AS title FROM c
""")
def mask_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and titles of private channels withheld."""
    private = F.col("channel").isin("whatsapp", "extension_private")
    return candidates(spark, sf_dir).select("doc_id", F.when(private, F.lit("[private]")).otherwise(F.substring("text", 1, 200)).alias("text"), F.when(~private, F.col("title")).alias("title"))


@query("""
    WITH page AS (SELECT page_id AS id, url, html FROM pages), doc AS (SELECT doc_id AS id, source, text FROM documents)
    SELECT coalesce(doc.id, page.id) AS id, CASE WHEN doc.id IS NULL OR doc.id % 2 = 0 THEN coalesce(page.url, doc.source) ELSE doc.source END AS origin,
           CASE WHEN page.id IS NOT NULL AND (doc.id IS NULL OR doc.id % 2 = 0) THEN length(page.html) ELSE length(doc.text) END AS size
    FROM doc FULL JOIN page ON doc.id = page.id
""")
def capture_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh capture replaces a row of its own and leaves one that another source owns."""
    page = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pid"), "url", "html")
    doc = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    own = F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 0)
    return doc.join(page, F.col("doc_id") == F.col("pid"), "full_outer").select(
        F.coalesce("doc_id", "pid").alias("id"),
        F.when(own, F.coalesce("url", "source")).otherwise(F.col("source")).alias("origin"),
        F.when(F.col("pid").isNotNull() & own, F.length("html")).otherwise(F.length("text")).cast("long").alias("size"),
    )


@query(f"""
    WITH {CANDIDATES_SQL} SELECT doc_id, channel, row_number() OVER (ORDER BY posted_s DESC, doc_id) + 1 AS sheet_row FROM c
""")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of all candidates in a sheet that has only its header yet."""
    from siltwork.operators.ranking import append_rows

    found = candidates(spark, sf_dir).select("doc_id", "channel", "posted_s")
    return append_rows(found, None, "doc_id", [F.desc("posted_s"), F.col("doc_id")], "sheet_row").select("doc_id", "channel", "sheet_row")


@query(f"""
    WITH {CANDIDATES_SQL}, bucket AS (SELECT d.doc_id, CAST(floor(s.similarity * 20) AS BIGINT) AS bucket, sha256('7:' || d.doc_id) AS h FROM documents d JOIN s USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) AS place FROM bucket) SELECT doc_id, bucket FROM r WHERE place <= 5
""".replace("WITH ", f"WITH {SIMILARITY_SQL}, ", 1))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows of each similarity bucket, chosen by a seeded hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(best_theses(spark, sf_dir), "doc_id")
    placed = rows.select("doc_id", F.floor(F.col("similarity") * 20).alias("bucket"), F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("h"))
    w = Window.partitionBy("bucket").orderBy("h")
    return placed.withColumn("place", F.row_number().over(w)).where("place <= 5").select("doc_id", "bucket")


@query(f"""
    WITH {CANDIDATES_SQL} SELECT author, count(*) AS n, round(max(pow(0.5, (1789171200 - posted_s) / 86400.0 / 90)), 9) AS freshest,
           min_by(doc_id, (-posted_s, doc_id)) AS latest FROM c GROUP BY author
""")
def author_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("fresh", recency((F.lit(NOW_SECONDS) - F.col("posted_s")) / DAY))
    latest = first_by(c, ["author"], F.desc("posted_s"), "doc_id").select("author", F.col("doc_id").alias("latest"))
    return c.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("fresh"), 9).alias("freshest")).join(latest, "author")


@query(f"""
    WITH {SIMILARITY_SQL}, j AS (SELECT d.source, s.thesis, s.similarity FROM documents d JOIN s USING (doc_id)),
    a AS (SELECT 'ALL' AS scope, similarity FROM j UNION ALL SELECT 'source: ' || source, similarity FROM j UNION ALL SELECT 'thesis: ' || thesis, similarity FROM j WHERE thesis IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY similarity) - 1 AS pos, count(*) OVER (PARTITION BY scope) AS n FROM a)
    SELECT scope, max(n) AS n, {', '.join(f"max(similarity) FILTER (WHERE pos = least(n * {p} // 100, n - 1)) AS p{p}" for p in (5, 25, 50, 75, 90, 95, 99))} FROM r GROUP BY scope
""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where similarities lie: overall, per source and per thesis."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(best_theses(spark, sf_dir), "doc_id")
    scopes = F.array(F.lit("ALL"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("thesis: "), "thesis"))
    scoped = joined.select(F.explode(scopes).alias("scope"), "similarity").where("scope IS NOT NULL AND similarity IS NOT NULL")
    counts = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return nearest_rank(scoped, ["scope"], "similarity", (5, 25, 50, 75, 90, 95, 99)).join(counts, "scope")


@query("""
    SELECT count(*) AS candidates, count(vec_id) AS scored, count(quality) AS reviewed_by_model, count(*) FILTER (WHERE toxic = 0) AS reviewed_by_you, count(DISTINCT source) AS sources, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars
    FROM documents LEFT JOIN embeddings ON vec_id = documents.doc_id LEFT JOIN labels ON labels.doc_id = documents.doc_id
""")
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far all candidates came, in one row and one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id")
    joined = docs.join(embedded, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count("vec_id").alias("scored"),
        F.count("quality").alias("reviewed_by_model"),
        F.count_if(F.col("toxic") == 0).alias("reviewed_by_you"),
        F.count_distinct("source").alias("sources"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n_chars"),
    )


@query("""
    WITH old AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'extension' WHEN 1 THEN 'extension_private' ELSE source END AS source, text, doc_id % 101 / 100.0::DOUBLE AS score, 't' || (doc_id % 5) AS thesis, doc_id % 2 AS reviewed FROM documents),
    new AS (SELECT page_id * 2 AS id, CASE WHEN page_id % 2 = 0 THEN 'extension' ELSE 'extension_private' END AS source, html AS text FROM pages),
    m AS (SELECT coalesce(old.id, new.id) AS id, new.id IS NOT NULL AND (old.id IS NULL OR old.source IN ('extension', 'extension_private')) AS taken, old.source AS os, old.text AS ot, old.score, old.thesis, old.reviewed, new.source AS ns, new.text AS nt FROM old FULL JOIN new ON old.id = new.id)
    SELECT id, CASE WHEN taken THEN ns ELSE os END AS source, sha256(coalesce(CASE WHEN taken THEN nt ELSE ot END, '')) AS text_sha256, CASE WHEN NOT taken THEN score END AS score, CASE WHEN NOT taken THEN thesis END AS thesis, reviewed FROM m
""")
def capture_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured again: what was derived from the old text goes, reviews and other sources' rows stay."""
    n = F.col("doc_id")
    owner = F.when(n % 3 == 0, "extension").when(n % 3 == 1, "extension_private").otherwise(F.col("source"))
    stored = table(spark, sf_dir, "documents").select(n.alias("id"), owner.alias("source"), "text", (n % 101 / 100).alias("score"), F.concat(F.lit("t"), n % 5).alias("thesis"), (n % 2).alias("reviewed"))
    p = F.col("page_id")
    captured = table(spark, sf_dir, "pages").select((p * 2).alias("id"), F.when(p % 2 == 0, "extension").otherwise("extension_private").alias("source"), F.col("html").alias("text"))
    done = refresh_captures(stored, captured, "id", "source", ("extension", "extension_private"), ("source", "text"), ("score", "thesis"))
    return done.select("id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "score", "thesis", "reviewed")


@query("""
    WITH old AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, [source] AS sources FROM documents), new AS (SELECT doc_id + 7 AS id, lang, [source, 'again'] AS sources FROM documents)
    SELECT coalesce(old.id, new.id) AS id, coalesce(old.lang, new.lang) AS lang, array_to_string(list_sort(list_distinct(list_concat(coalesce(old.sources, []), coalesce(new.sources, [])))), ',') AS sources FROM old FULL JOIN new ON old.id = new.id
""")
def fill_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coalescing update that gathers the sources of both sides."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END").alias("lang"), F.array("source").alias("sources"))
    new = docs.select((F.col("doc_id") + 7).alias("id"), "lang", F.array(F.col("source"), F.lit("again")).alias("sources"))
    return fill_missing(old, new, "id", ["lang"], ["sources"]).select("id", "lang", F.array_join("sources", ",").alias("sources"))
