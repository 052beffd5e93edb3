"""Records and edges out of stored answers, made from the driver tables as JSON and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.functions import signals as G
from siltwork.functions import text as T
from siltwork.functions.profiles import source_reliability as reliability_of
from siltwork.plans.frames import DAY, NOW_SECONDS, table
from siltwork.plans.registry import query
from siltwork.sources import records as R

STRIP_SQL = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
TAGS_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+', ''), '\\s+$', '')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def answers(rows: DataFrame, node: F.Column, body: F.Column) -> DataFrame:
    return rows.select(node.alias("node"), F.to_json(body).alias("body"))


def digest(records: DataFrame) -> DataFrame:
    """Records with their text as a hash."""
    return records.select("source_url", F.sha2("raw_text", 256).alias("text_sha256"), F.length("title").alias("title_chars"), "author", "node", "posted_at")


def number() -> F.Column:
    return F.col("doc_id")


@query(f"""
    WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<p>' || substr(text, 1, 80) || '</p>' END AS description, substr(text, 5, 50) AS short, substr(text, 1, 30) AS title FROM documents)
    SELECT 'https://pub/' || doc_id AS source_url, sha256({STRIP_SQL.format("title || chr(10) || chr(10) || CASE WHEN " + TAGS_SQL.format("description") + " <> '' THEN " + TAGS_SQL.format("description") + " ELSE " + TAGS_SQL.format("short") + " END")}) AS text_sha256,
        length(title) AS title_chars, CASE WHEN doc_id % 4 <> 0 THEN 'w' || (doc_id % 9) END AS author, 'pub' || (doc_id % 20) AS node, '2026-01-01' AS posted_at FROM d
""")
def newsletter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of archives; those without an address are left out."""
    null = F.lit(None).cast("string")

    def post(url: F.Column) -> F.Column:
        by = F.when(number() % 4 != 0, F.array(F.struct(F.concat(F.lit("w"), number() % 9).alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
        description = F.when(number() % 3 == 0, "").otherwise(F.concat(F.lit("<p>"), F.substring("text", 1, 80), F.lit("</p>")))
        return F.struct(url.alias("canonical_url"), F.substring("text", 1, 30).alias("title"), description.alias("description"), F.substring("text", 5, 50).alias("truncated_body_text"), by.alias("publishedBylines"), F.lit("2026-01-01").alias("post_date"))

    given = answers(documents(spark, sf_dir), F.concat(F.lit("pub"), number() % 20), F.array(post(F.concat(F.lit("https://pub/"), number())), post(null), post(F.lit(""))))
    return digest(R.newsletter_posts(given))


@query("""
    WITH p AS (SELECT user_id AS node, day(ts) - 1 AS page, list(event_id ORDER BY event_id) AS posts FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY page) - 1 AS no, bool_and(len(posts) >= 2) OVER (PARTITION BY node ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_before FROM p),
    k AS (SELECT node, page, unnest(posts) AS post, generate_subscripts(posts, 1) - 1 AS place FROM r WHERE page = no AND coalesce(full_before, true))
    SELECT CAST(node AS BIGINT) AS node, page, place AS "at", post FROM k WHERE page * 2 + place < 7
""")
def archive_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages read up to the first short one, and seven posts in all."""
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), (F.dayofmonth("ts") - 1).alias("page")).agg(F.array_sort(F.collect_list("event_id")).alias("posts"))
    return R.archive_pages(pages, 2, 7).select("node", "page", "at", "post")


@query("""
    SELECT 'substack' AS source, 'pub' || (doc_id % 20) AS node, 'sub' || (doc_id % 50) AS neighbour FROM documents WHERE doc_id % 5 <> 0
    UNION SELECT 'hackernews', 'query:q' || (doc_id % 8), 'author:u' || (doc_id % 97) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0
    UNION SELECT 'github', 'query:q' || (doc_id % 8), 'org:o' || (doc_id % 31) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0
""")
def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source leads to: recommendations, authors of searches, owners that are organizations."""
    d = documents(spark, sf_dir)
    node = F.when(number() % 2 == 0, F.concat(F.lit("query:q"), number() % 8)).otherwise(F.concat(F.lit("author:u"), number() % 8))
    letters = answers(d, F.concat(F.lit("pub"), number() % 20), F.array(F.struct(F.struct(F.when(number() % 5 != 0, F.concat(F.lit("sub"), number() % 50)).alias("subdomain")).alias("recommendedPublication"))))
    hits = answers(d, node, F.struct(F.array(F.struct(number().cast("string").alias("objectID"), F.when(number() % 7 != 0, F.concat(F.lit("u"), number() % 97)).alias("author"))).alias("hits")))
    owner = F.struct(F.concat(F.lit("o"), number() % 31).alias("login"), F.when(number() % 3 == 0, "Organization").otherwise("User").alias("type"))
    repos = answers(d, node, F.struct(F.array(F.struct(owner.alias("owner"))).alias("items")))
    return R.newsletter_edges(letters).unionByName(R.forum_edges(hits)).unionByName(R.repository_edges(repos)).distinct()


@query(f"""
    WITH d AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(text, 1, 30) END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(text, 30, 60) END AS story FROM documents WHERE doc_id % 10 <> 9)
    SELECT 'https://news.ycombinator.com/item?id=' || doc_id AS source_url, sha256({STRIP_SQL.format("coalesce(title, 'Story') || chr(10) || chr(10) || CASE WHEN story <> '' THEN story ELSE 'comment' END || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'https://x.dev' ELSE '' END")}) AS text_sha256,
        length(coalesce(title, 'Story')) AS title_chars, 'u' || (doc_id % 97) AS author, 'query:q' || (doc_id % 8) AS node, '2026-01-02' AS posted_at FROM d
""")
def forum_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.struct(
        F.when(number() % 10 != 9, number().cast("string")).alias("objectID"), F.when(number() % 4 != 0, F.substring("text", 1, 30)).alias("title"), F.lit("Story").alias("story_title"), F.when(number() % 3 == 0, "").otherwise(F.substring("text", 30, 60)).alias("story_text"),
        F.lit("comment").alias("comment_text"), F.when(number() % 2 == 0, "https://x.dev").alias("url"), F.concat(F.lit("u"), number() % 97).alias("author"), F.lit("2026-01-02").alias("created_at"),
    )
    return digest(R.forum_hits(answers(documents(spark, sf_dir), F.concat(F.lit("query:q"), number() % 8), F.struct(F.array(hit).alias("hits")))))


@query("""
    WITH d AS (SELECT *, 'o' || (doc_id % 31) || '/r' || doc_id AS full_name FROM documents)
    SELECT 'https://github.com/' || full_name AS source_url, sha256(concat_ws(chr(10) || chr(10), full_name, CASE WHEN doc_id % 3 <> 0 AND substr(text, 1, 80) <> '' THEN substr(text, 1, 80) END, CASE WHEN doc_id % 2 = 0 THEN 'ai sql' END, (doc_id % 500) || ' stars, created 2026-01-03', CASE WHEN doc_id % 5 = 0 THEN 'https://home.dev' END)) AS text_sha256,
        length(full_name) AS title_chars, 'o' || (doc_id % 31) AS author, 'query:q' || (doc_id % 8) AS node, '2026-01-03T00:00:00Z' AS posted_at FROM d
""")
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories; empty parts of the text leave no gap."""
    login = F.concat(F.lit("o"), number() % 31)
    name = F.concat(login, F.lit("/r"), number())
    repo = F.struct(
        F.concat(F.lit("https://github.com/"), name).alias("html_url"), name.alias("full_name"), F.when(number() % 3 != 0, F.substring("text", 1, 80)).alias("description"), F.when(number() % 2 == 0, F.array(F.lit("ai"), F.lit("sql"))).alias("topics"),
        (number() % 500).alias("stargazers_count"), F.lit("2026-01-03T00:00:00Z").alias("created_at"), F.when(number() % 5 == 0, "https://home.dev").otherwise("").alias("homepage"), F.struct(login.alias("login")).alias("owner"),
    )
    return digest(R.repositories(answers(documents(spark, sf_dir), F.concat(F.lit("query:q"), number() % 8), F.struct(F.array(repo).alias("items")))))


@query(f"""
    SELECT 'https://reddit.com/r/' || doc_id AS source_url, sha256({STRIP_SQL.format("substr(text, 1, 40) || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(text, 40, 200) END")}) AS text_sha256, length(substr(text, 1, 40)) AS title_chars,
        CASE WHEN doc_id % 6 <> 0 THEN 'u' || (doc_id % 97) END AS author, 'n' || (doc_id % 13) AS node, strftime(make_timestamp((1700000000 + doc_id * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS posted_at FROM documents
""")
def community_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.struct(F.concat(F.lit("/r/"), number()).alias("permalink"), F.substring("text", 1, 40).alias("title"), F.when(number() % 3 != 0, F.substring("text", 40, 200)).alias("selftext"), F.when(number() % 6 != 0, F.concat(F.lit("u"), number() % 97)).alias("author"), (F.lit(1700000000) + number() * 3600).cast("double").alias("created_utc"))
    return digest(R.community_posts(answers(documents(spark, sf_dir), F.concat(F.lit("n"), number() % 13), F.array(post))))


@query(f"""
    WITH h AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Please VERIFY ' || html ELSE html || '<a href="/in/p-' || (page_id % 7) || '/">a</a><a href="/in/q%20' || page_id || '">b</a><a href="/in/p-' || (page_id % 7) || '/">c</a>' END AS html FROM pages),
    k AS (SELECT * FROM h WHERE NOT regexp_matches(lower(html), 'authwall|checkpoint/challenge|unusual activity|please verify|sign in to continue'))
    SELECT 'p' || page_id AS node, sha256(substr({TAGS_SQL.format("html")}, 1, 8000)) AS text_sha256, array_to_string(list_distinct_ordered[1:8], ',') AS neighbours FROM (
        SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS list_distinct_ordered FROM (SELECT *, regexp_extract_all(html, '/in/([A-Za-z0-9\\-%]{{3,80}})/?"', 1) AS found FROM k))
""")
def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile pages and the first profiles they link to; pages that ask for a login are left out."""
    p = F.col("page_id")
    links = F.concat(F.lit('<a href="/in/p-'), p % 7, F.lit('/">a</a><a href="/in/q%20'), p, F.lit('">b</a><a href="/in/p-'), p % 7, F.lit('/">c</a>'))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), p).alias("node"), F.when(p % 9 == 0, F.concat(F.lit("Please VERIFY "), "html")).otherwise(F.concat("html", links)).alias("html"))
    edges = R.also_viewed(pages).groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "neighbour"))), lambda x: x["neighbour"]).alias("n"))
    return R.profile_pages(pages).join(edges, "node", "left").select("node", F.sha2("raw_text", 256).alias("text_sha256"), F.coalesce(F.array_join("n", ","), F.lit("")).alias("neighbours"))


@query("""
    WITH e AS (SELECT event_id, user_id, CAST(floor(value * 10) AS BIGINT) AS votes, user_id % 300 AS comments, user_id % 3 AS makers FROM events),
    s AS (SELECT *, CAST(floor(round(CAST(least(100.0::DOUBLE, least(votes, 1000) * 0.055::DOUBLE + least(comments, 200) * 0.16::DOUBLE + CASE WHEN makers > 0 THEN 8 ELSE 0 END + 6) AS DOUBLE), 9) + 0.5) AS BIGINT) AS strength FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, event_id) AS place FROM s)
    SELECT 'q' || user_id AS node, place, 'Launch ' || event_id AS name, strength FROM r WHERE place <= 5
""")
def launch_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest launches of each search."""
    from pyspark.sql import Window

    e = F.col("event_id")
    makers = F.slice(F.array(F.struct(F.lit("a").alias("username")), F.struct(F.lit("b").alias("username"))), F.lit(1), (F.col("user_id") % 3).cast("int"))
    node = F.struct(F.concat(F.lit("Launch "), e).alias("name"), F.lit("A tagline of more than twenty").alias("tagline"), F.lit("https://x").alias("url"), F.floor(F.col("value") * 10).alias("votesCount"), (F.col("user_id") % 300).alias("commentsCount"), makers.alias("makers"), e.cast("string").alias("createdAt"))
    body = F.struct(F.struct(F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("posts")).alias("data"))
    found = R.launches(answers(table(spark, sf_dir, "events"), F.concat(F.lit("q"), "user_id"), body))
    scored = found.select("node", "name", F.col("created_at").cast("long").alias("e"), S.launch_strength(F.col("votes"), F.col("comments"), F.col("makers"), F.col("tagline")).alias("strength"))
    w = Window.partitionBy("node").orderBy(F.desc("strength"), "e")
    return scored.withColumn("place", F.row_number().over(w)).where("place <= 5").select("node", "place", "name", "strength")


@query(f"""
    SELECT conv_id AS story, conv_id * 1000 + turn AS comment, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, role AS author, sha256({TAGS_SQL.format("coalesce(text, '')")}) AS text_sha256 FROM conversations WHERE role <> 'system'
""")
def story_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories and the comments that they list."""
    c = table(spark, sf_dir, "conversations").where("role != 'system'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    stories = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("id")).alias("kids")).select(F.to_json(F.struct((-F.col("conv_id") - 1).alias("id"), F.lit("story").alias("type"), "kids")).alias("body"))
    comments = c.select(F.to_json(F.struct("id", F.lit("comment").alias("type"), F.col("role").alias("by"), "text")).alias("body"))
    found = R.story_comments(stories.unionByName(comments))
    return found.select((-F.col("story") - 1).alias("story"), "comment", "at", "author", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
    WITH d AS (SELECT doc_id, text, 1789171200 - (doc_id * 37 % 720) * 86400 AS s, CASE WHEN doc_id % 5 = 0 THEN ' Show HN: ' ELSE '' END || substr(text, 1, 20) || CASE WHEN doc_id % 3 = 0 THEN ' live demo of our api docs, would pay' ELSE ' is broken, pay for a workaround' END AS title FROM documents),
    k AS (SELECT *, greatest(0.25, least(1.0, exp(-((1789171200 - s) / 86400.0) / 180)))::DOUBLE AS decay, lower(title) AS low FROM d WHERE s > 1789171200 - 365 * 86400)
    SELECT CAST(doc_id AS VARCHAR) AS hit, CASE WHEN regexp_matches(trim(title), '(?i)^show hn:?') THEN 'show_hn' ELSE 'story' END AS kind, CAST(floor((doc_id % 400) * decay + 0.5) AS BIGINT) AS score,
        array_to_string(list_filter([CASE WHEN contains(low, 'would pay') OR contains(low, 'pay for') THEN 'willingness to pay' END, CASE WHEN contains(low, 'is broken') OR contains(low, 'frustrating') THEN 'high-friction language' END, CASE WHEN contains(low, 'workaround') THEN 'workaround language' END], lambda x: x IS NOT NULL), ',') AS pain,
        array_to_string(list_filter([CASE WHEN contains(low, 'live demo') THEN 'demo available' END, CASE WHEN contains(low, 'api docs') THEN 'API discussed' END], lambda x: x IS NOT NULL), ',') AS product,
        array_to_string(list_filter([CASE WHEN contains(low, 'demo') THEN 'demo available' END, CASE WHEN doc_id % 4 = 0 OR contains(low, 'github') THEN 'source or repo linked' END, CASE WHEN contains(low, 'waitlist') THEN 'waitlist only' END, CASE WHEN contains(low, 'api') THEN 'API surface' END], lambda x: x IS NOT NULL), ',') AS shown FROM k
""")
def story_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the last year with decayed points and what their words signal."""
    title = F.concat(F.when(number() % 5 == 0, " Show HN: ").otherwise(""), F.substring("text", 1, 20), F.when(number() % 3 == 0, " live demo of our api docs, would pay").otherwise(" is broken, pay for a workaround"))
    hit = F.struct(number().cast("string").alias("objectID"), title.alias("title"), (F.lit(NOW_SECONDS) - number() * 37 % 720 * DAY).alias("created_at_i"), (number() % 400).alias("points"), F.when(number() % 4 == 0, "https://github.com/a").alias("url"))
    found = R.recent_hits(answers(documents(spark, sf_dir), F.lit("q"), F.struct(F.array(hit).alias("hits"))), NOW_SECONDS)
    title, age = F.col("r.title"), (F.lit(NOW_SECONDS) - F.col("r.created_at_i")) / DAY

    def labels(lexicon) -> F.Column:
        return F.array_join(F.transform(G.lexicon_labels(title, lexicon), lambda x: x["label"]), ",")

    return found.select(
        F.col("r.objectID").alias("hit"),
        F.when(G.shows_product(title), "show_hn").otherwise("story").alias("kind"),
        G.story_score(F.col("r.points"), age).alias("score"),
        labels(G.PAIN).alias("pain"),
        labels(G.PRODUCT).alias("product"),
        F.array_join(G.shown(title, F.col("r.url"), F.lit(None).cast("string")), ",").alias("shown"),
    )


@query("""
    WITH d AS (SELECT doc_id, text, (doc_id * 37 % 720) AS age, CASE doc_id % 4 WHEN 0 THEN ['src/a.py', 'tests/a.py', '.github/workflows/ci.yml'] WHEN 1 THEN ['docs/x.md', 'contest/a'] WHEN 2 THEN ['a/spec.ts', 'Example/b', '.travis.yml'] ELSE [] END AS paths FROM documents),
    q AS (SELECT *, CAST(floor(least(least(length(text) / 80.0, 35.0) + least(len(regexp_extract_all(text, '(?m)^#+\\s')) * 2, 15) + least(len(regexp_extract_all(text, '```')) * 2.0, 15.0) + least(len(regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)')) * 1.5, 10.0)
        + CASE WHEN regexp_matches(lower(text), 'example|usage|quickstart|getting started') THEN 9 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'install|setup|requirements|prerequisites') THEN 7 ELSE 0 END
        + CASE WHEN regexp_matches(lower(text), 'license|mit|apache') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'contribut|pull request|issue tracker') THEN 5 ELSE 0 END, 100.0)::DOUBLE + 0.5) AS BIGINT) AS readme FROM d)
    SELECT doc_id, CAST(floor(readme * CASE WHEN age < 30 THEN 1.0 WHEN age < 180 THEN 0.85 WHEN age < 365 THEN 0.6 ELSE 0.3 END::DOUBLE + CASE WHEN doc_id % 4 IN (0, 2) THEN 6 ELSE 0 END + 0.5) AS BIGINT) AS quality, doc_id % 4 IN (0, 2) AS tests, doc_id % 4 IN (1, 2) AS docs FROM q
""")
def repository_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of repositories by their description, last commit and paths."""
    lists = [("src/a.py", "tests/a.py", ".github/workflows/ci.yml"), ("docs/x.md", "contest/a"), ("a/spec.ts", "Example/b", ".travis.yml")]
    paths = F.array().cast("array<string>")
    for k, given in enumerate(lists):
        paths = F.when(number() % 4 == k, F.array(*map(F.lit, given))).otherwise(paths)
    d = documents(spark, sf_dir).withColumn("paths", paths)
    return d.select("doc_id", G.repository_quality(F.col("text"), F.col("paths"), number() * 37 % 720).alias("quality"), G.any_path(F.col("paths"), G.TEST_PATH).alias("tests"), G.any_path(F.col("paths"), G.DOCS_PATH).alias("docs"))


@query("""
    WITH u AS (SELECT page_id, ['https://www.LinkedIn.com/in/a', 'https://linkedin.com/sales/lead', 'https://mail.google.com/mail', 'https://outlook.office.com/x', 'not a url', 'https://notlinkedin.com/recruiters', url][page_id % 7 + 1] AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 7 IN (0, 1) THEN true ELSE false END AS network, page_id % 7 = 1 AS product, page_id % 7 IN (2, 3) AS mailbox,
        CASE page_id % 7 WHEN 0 THEN 'medium_high' WHEN 1 THEN 'medium_high' WHEN 2 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'medium_low' WHEN 5 THEN 'medium_high'
            ELSE CASE WHEN regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '(^|\\.)company|\\.com$') AND NOT regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), 'linkedin|twitter|x\\.com|reddit') THEN 'high' ELSE 'medium_low' END END AS reliability FROM u
""")
def address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of address a page has, and how far its host can be trusted."""
    given = ("https://www.LinkedIn.com/in/a", "https://linkedin.com/sales/lead", "https://mail.google.com/mail", "https://outlook.office.com/x", "not a url", "https://notlinkedin.com/recruiters")
    url = F.when(F.col("page_id") % 7 == 6, F.col("url")).otherwise(F.get(F.array(*map(F.lit, given)), (F.col("page_id") % 7).cast("int")))
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    u = F.col("url")
    return p.select("page_id", G.network_page(u).alias("network"), G.network_product(u).alias("product"), G.mailbox_page(u).alias("mailbox"), reliability_of(u, F.lit("")).alias("reliability"))


@query("""
    WITH d AS (SELECT doc_id, substr(text, 1, 60) || ['', ' · 2nd', ' Contact Info', ' 12 connections Message Highlights', ' 12 connections message', ' see LinkedIn.com', ' prototype', ' series a round', ' CEO of it'][doc_id % 9 + 1] AS t FROM documents),
    k AS (SELECT doc_id, lower(t) AS t FROM d)
    SELECT doc_id, regexp_matches(t, '·\\s*(1st|2nd|3rd)|mutual connection|contact info|linkedin\\.com') OR (contains(t, 'connection') AND regexp_matches(t, '\\bmessage\\b') AND regexp_matches(t, '\\bhighlights?\\b')) AS pasted,
        regexp_matches(t, '(^|[^a-z0-9_])(founder|co-founder|ceo|cto|building|startup|experience|education|about)([^a-z0-9_]|$)') AS profile_like,
        CASE WHEN contains(t, 'idea') THEN 'idea' WHEN contains(t, 'prototype') THEN 'prototype' WHEN contains(t, 'pre-seed') OR contains(t, 'pre seed') THEN 'pre-seed' WHEN contains(t, 'seed') THEN 'seed' WHEN contains(t, 'series-a') OR contains(t, 'series a') THEN 'series-a' WHEN contains(t, 'growth') THEN 'growth' ELSE 'seed' END AS stage FROM k
""")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is a pasted profile or like one, and the stage it names."""
    tails = ("", " · 2nd", " Contact Info", " 12 connections Message Highlights", " 12 connections message", " see LinkedIn.com", " prototype", " series a round", " CEO of it")
    t = documents(spark, sf_dir).select("doc_id", F.concat(F.substring("text", 1, 60), F.get(F.array(*map(F.lit, tails)), (number() % 9).cast("int"))).alias("t"))
    return t.select("doc_id", G.pasted_profile(F.col("t")).alias("pasted"), G.profile_like(F.col("t")).alias("profile_like"), G.stage_of(F.col("t")).alias("stage"))


@query(r"""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'P ' || doc_id END AS name, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Co' || (doc_id % 50) END AS company, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 1, 60) END AS about FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(company || '  ' || about, '[^A-Za-z0-9_]+'), lambda x: length(x) > 4) AS words FROM d)
    SELECT doc_id, CAST(CASE WHEN company <> '' THEN 7 ELSE 0 END + CASE WHEN name <> '' THEN 2 WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN len(words) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n,
        coalesce(CASE WHEN company <> '' THEN '"' || company || '" startup founder product' WHEN name <> '' THEN '"' || name || '" founder startup' END, '') AS first, coalesce(CASE WHEN len(words) > 0 THEN '"' || array_to_string(words[1:6], ' ') || '" market size startup' END, '') AS market FROM w
""")
def research_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search phrases about each person and company."""
    name, company = F.when(number() % 3 == 0, "").otherwise(F.concat(F.lit("P "), number())), F.when(number() % 2 == 0, "").otherwise(F.concat(F.lit("Co"), number() % 50))
    about = F.when(number() % 5 == 0, "").otherwise(F.substring("text", 1, 60))
    q = documents(spark, sf_dir).select("doc_id", G.research_queries(name, company, F.lit(""), about).alias("q"))
    named = F.filter("q", lambda x: x.contains("founder"))
    market = F.filter("q", lambda x: x.endswith("market size startup"))
    first = F.filter(named, lambda x: ~x.contains("co-founder"))
    return q.select("doc_id", F.size("q").cast("long").alias("n"), F.coalesce(F.get(first, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get(market, F.lit(0)), F.lit("")).alias("market"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_sha256 FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(G.html_escaped(F.col("html")), 256).alias("escaped_sha256"))


@query(f"SELECT page_id, {TAGS_SQL.format('html')} <> '' AS shown, len(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: regexp_matches(x, '^https?://')))) AS n_http FROM pages")
def page_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page shows text, and its distinct web links (80 are kept; no page here has more)."""
    found = F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda u: u.rlike("^https?://")))
    return table(spark, sf_dir, "pages").select("page_id", (T.tags_off(F.col("html")) != "").alias("shown"), F.size(F.slice(found, 1, 80)).cast("long").alias("n_http"))
