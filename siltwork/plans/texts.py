"""Filters, redaction, extraction and matching over texts, pages and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators.filters import RULES, reject, rejection
from siltwork.plans.frames import CANDIDATES_SQL, DAY, NOW_SECONDS, candidates, dealt, table
from siltwork.plans.registry import query

#: The tables' prose is made of invented words, so the word lists come from it.
TERMS = ("trash", "clown", "worthless", "loser", "!!", "***")
PATTERNS = RULES | {"promo": r"[!]{2}", "job_ad": r"[&]{3}", "question": r"^(The|De|La|Die) ", "builder": r" (and|und|et|con) "}
NAMES = ("Mozilla", "thorn")


@query(f"""
    WITH {CANDIDATES_SQL}, r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t, text, (1789171200 - posted_s) // 86400 AS days FROM c)
    SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM (
        SELECT doc_id, CASE WHEN length(t) < 40 THEN 'too_short' WHEN regexp_matches(text, '[!]{{2}}') THEN 'promo' WHEN regexp_matches(text, '[&]{{3}}') THEN 'job_ad'
            WHEN regexp_matches(t, '^(The|De|La|Die) ') AND NOT regexp_matches(text, ' (and|und|et|con) ') THEN 'question' WHEN days > 540 THEN 'too_old' ELSE 'kept' END AS reason FROM r)
    GROUP BY reason
""")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each rule rejects; the first rule that holds counts."""
    c = candidates(spark, sf_dir)
    reason = reject(F.col("text"), F.col("posted_s"), NOW_SECONDS, PATTERNS)
    return c.select("doc_id", F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"""
    WITH {CANDIDATES_SQL}, r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t, text || [' now hiring, apply now', ' Use this COUPON', ' nothing', ' my startup'][doc_id % 4 + 1] AS x, (1789171200 - posted_s) // 86400 AS days FROM c)
    SELECT doc_id, CASE WHEN length(regexp_replace(x, '^\\s+', '')) < 40 THEN 'too_short' WHEN doc_id % 4 = 1 THEN 'promo' WHEN doc_id % 4 = 0 THEN 'job_ad' WHEN days > 540 THEN 'too_old' END AS filter,
        CASE WHEN length(regexp_replace(x, '^\\s+', '')) < 40 THEN length(regexp_replace(x, '^\\s+', '')) || ' chars, under 40' WHEN doc_id % 4 = 1 THEN 'promotional: COUPON' WHEN doc_id % 4 = 0 THEN 'reads as a vacancy: now hiring' WHEN days > 540 THEN days || ' days old, over 540' END AS reason FROM r
""")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that rejects each candidate and what it found, by the shipped English rules."""
    tails = F.array(*map(F.lit, (" now hiring, apply now", " Use this COUPON", " nothing", " my startup")))
    c = dealt(candidates(spark, sf_dir).select("doc_id", "text", "posted_s"), "doc_id").withColumn("x", F.concat("text", F.element_at(tails, (F.col("doc_id") % 4 + 1).cast("int"))))
    return c.select("doc_id", rejection(F.col("x"), F.col("posted_s"), NOW_SECONDS).alias("r")).select("doc_id", "r.filter", "r.reason")


@query(f"""
    WITH {CANDIDATES_SQL} SELECT doc_id, age_days, round(CASE WHEN age_days < 0 THEN 1.0 ELSE pow(0.5, age_days / 90.0) END, 9) AS recency, age_days > 540 AS too_old,
           round(greatest(0.25, least(1.0, exp(-age_days / 180.0))), 9) AS decay, CASE WHEN age_days < 30 THEN 1.0 WHEN age_days < 180 THEN 0.85 WHEN age_days < 365 THEN 0.6 ELSE 0.3 END::DOUBLE AS commits
    FROM (SELECT doc_id, (1789171200 - posted_s) // 86400 AS age_days FROM c)
""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltwork.functions.scores import commit_recency, decay
    from siltwork.functions.scores import recency as fresh

    c = candidates(spark, sf_dir).select("doc_id", F.expr(f"({NOW_SECONDS} - posted_s) div {DAY}").alias("age_days"))
    age = F.col("age_days")
    return c.select("doc_id", "age_days", F.round(fresh(age), 9).alias("recency"), (age > 540).alias("too_old"), F.round(decay(age), 9).alias("decay"), commit_recency(age).alias("commits"))


@query("""
    SELECT doc_id, (SELECT bool_or(contains(lower(text), t)) FROM unnest(['trash','clown']) u(t)) AS excluded,
           len(list_filter(['trash','clown','worthless','loser','!!','***'], lambda x: contains(lower(text), x))) AS hits,
           array_to_string(list_filter(['trash','clown','worthless','loser','!!','***'], lambda x: contains(lower(text), x)), ',') AS terms FROM documents
""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a list that a text holds, and whether a thesis excludes it."""
    hits = T.term_hits(F.col("text"), TERMS)
    return table(spark, sf_dir, "documents").select("doc_id", T.any_term(F.col("text"), TERMS[:2]).alias("excluded"), F.size(hits).cast("long").alias("hits"), F.array_join(hits, ",").alias("terms"))


SENTENCES_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"
LEAD_SQL = "(regexp_matches(x, 'https?://\\S+') OR contains(lower(x), 'trash') OR contains(lower(x), 'clown') OR contains(lower(x), 'worthless') OR contains(lower(x), 'loser') OR contains(lower(x), '!!') OR contains(lower(x), '***'))"
SCRUB_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[A-Za-z0-9_]([A-Za-z0-9_.+-]*)@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]*[A-Za-z0-9_]', '[email]', 'g'), '[+(]?\d[\d\s().-]{{6,}}\d', '[phone]', 'g'), '[@~][A-Za-z0-9_][A-Za-z0-9_.-]*', '[handle]', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+', ''), '\s+$', '')"


MAIL_SQL, PHONE_SQL, HANDLE_SQL = r"[A-Za-z0-9_]([A-Za-z0-9_.+-]*)@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]*[A-Za-z0-9_]", r"[+(]?\d[\d\s().-]{6,}\d", r"[@~][A-Za-z0-9_][A-Za-z0-9_.-]*"


@query(f"""
    SELECT doc_id, len(regexp_extract_all(text, '{MAIL_SQL}')) AS addresses, len(regexp_extract_all(text, '{PHONE_SQL}')) AS numbers, len(regexp_extract_all(text, '{HANDLE_SQL}')) AS handles,
           sha256({SCRUB_SQL.format('text')}) AS masked_sha256
    FROM documents
""")
def redact_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, numbers and handles found, and all of them masked."""
    text = F.col("text")
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(c) for c, p in (("addresses", T.EMAIL), ("numbers", T.PHONE), ("handles", T.HANDLE))]
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", *counts, F.sha2(T.scrub(text), 256).alias("masked_sha256"))


@query(f"""
    WITH p AS (SELECT conv_id, turn, {SENTENCES_SQL} AS parts FROM conversations), l AS (SELECT *, list_filter(parts, lambda x: {LEAD_SQL}) AS leads FROM p),
    s AS (SELECT conv_id, turn, array_to_string(CASE WHEN len(leads) > 0 THEN leads ELSE parts[1:1] END, ' ') AS t FROM l)
    SELECT conv_id, turn, substr(regexp_replace({SCRUB_SQL.format('t')}, '(?i)\\b(Mozilla|thorn)\\b', '[name]', 'g'), 1, 400) AS fragment FROM s
""")
def redact_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn only the sentences that carry a lead, scrubbed and cut."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.fragment(F.col("text"), TERMS, NAMES).alias("fragment"))


@query("""
    SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256, n_links, coalesce(first_link, '') AS first_link FROM (
        SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
               len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] AS first_link FROM pages)
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, and their distinct link targets."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    shown = T.tags_off(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(shown).cast("long").alias("n_chars"), F.sha2(shown, 256).alias("text_sha256"), F.size(found).cast("long").alias("n_links"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_link"))


@query("""
    SELECT host, count(*) AS pages, count(DISTINCT path) AS paths, bool_or(https) AS https FROM (
        SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, starts_with(url, 'https') AS https FROM pages)
    GROUP BY host
""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"), F.startswith("url", F.lit("https")).alias("https"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("path").alias("paths"), F.bool_or("https").alias("https"))


@query("""
    WITH line AS (SELECT conv_id, turn, trim(unnest(string_split(text, '.'))) AS line, generate_subscripts(string_split(text, '.'), 1) AS no FROM conversations),
    flagged AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END AS starts FROM line WHERE line <> ''),
    island AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn, no) AS message FROM flagged)
    SELECT conv_id, message, count(*) AS lines, min(turn) AS turn, sha256(string_agg(line, chr(10) ORDER BY turn, no)) AS text_sha256 FROM island WHERE message > 0 GROUP BY conv_id, message
""")
def chat_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put back together to messages: a line that does not begin one goes on with the last."""
    from siltwork.sources.chats import islands

    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    found = islands(lines, ["conv_id"], ["turn", "no"], F.col("line").rlike("^[A-Z]"), "message")
    return found.groupBy("conv_id", "message").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("turn").alias("turn"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "no", "line"))), lambda x: x["line"]), "\n"), 256).alias("text_sha256"),
    )


@query("""
    SELECT role, count(*) AS turns, count(*) FILTER (WHERE contains(lower(text), 'the') OR contains(lower(text), '!!')) AS leads FROM conversations GROUP BY role
""")
def lead_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns are kept; those with a link or a hint are promoted."""
    lead = T.is_lead(F.col("text"), ("the", "!!"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(lead).alias("leads"))


@query("""
    SELECT doc_id, length(kept) AS n_chars, sha256(kept) AS kept_sha256 FROM (
        SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, cut - 1) END, '^\\s+', ''), '\\s+$', '') AS kept FROM (
            SELECT doc_id, text, list_min(list_filter([strpos(lower(text), chr(10) || 'the'), strpos(lower(text), chr(10) || 'de '), strpos(lower(text), ' license')], lambda x: x > 1)) AS cut FROM documents))
""")
def inbound_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts above the earliest marker."""
    kept = T.mail_body(F.col("text"), ("\nthe", "\nde ", " license"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query("""
    WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN reverse(substr(text, 1, 25)) WHEN doc_id % 7 = 0 THEN '  ' ELSE replace(substr(text, 3, 25), ' ', '  ') END AS quote FROM documents)
    SELECT doc_id, trim(quote) <> '' AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))) AS grounded FROM q
""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote stands in its text, white space and case aside."""
    quote = F.when(F.col("doc_id") % 3 == 0, F.reverse(F.substring("text", 1, 25))).when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.replace(F.substring("text", 3, 25), F.lit(" "), F.lit("  ")))
    return table(spark, sf_dir, "documents").select("doc_id", T.quote_in(quote, F.col("text")).alias("grounded"))


@query("""
    WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'https://' || substr(text, 1, 50) || '/' WHEN 1 THEN 'unknown' WHEN 2 THEN 'invented claim' ELSE substr(text, 5, 30) END AS claim FROM documents),
    p AS (SELECT doc_id, text, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(claim, '^\\s+', ''), '\\s+$', '')), '^https?://', ''), '/+$', '') AS plain FROM q)
    SELECT doc_id, plain IN ('', 'n/a', 'unknown', 'none') OR contains(lower(text), substr(plain, 1, 40)) AS grounded FROM p
""")
def report_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the start of a claim stands in its text; words for "not known" pass."""
    kind = F.col("doc_id") % 4
    claim = F.when(kind == 0, F.concat(F.lit("https://"), F.substring("text", 1, 50), F.lit("/"))).when(kind == 1, "unknown").when(kind == 2, "invented claim").otherwise(F.substring("text", 5, 30))
    return table(spark, sf_dir, "documents").select("doc_id", T.claim_in(claim, F.col("text")).alias("grounded"))


@query("""
    WITH p AS (SELECT doc_id, least(length(text) / 80.0, 35.0) + least(len(regexp_extract_all(text, '(?m)^#+\\s')) * 2, 15) + least(len(regexp_extract_all(text, '```')) * 2.0, 15.0)
        + least(len(regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)')) * 1.5, 10.0)
        + CASE WHEN regexp_matches(lower(text), 'example|usage|quickstart|getting started') THEN 9 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'install|setup|requirements|prerequisites') THEN 7 ELSE 0 END
        + CASE WHEN regexp_matches(lower(text), 'license|mit|apache') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'contribut|pull request|issue tracker') THEN 5 ELSE 0 END AS points FROM documents)
    SELECT doc_id, CAST(floor(least(points, 100.0)::DOUBLE + 0.5) AS BIGINT) AS quality FROM p
""")
def readme_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.readme_quality(F.col("text")).alias("quality"))


@query("""
    SELECT doc_id, regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
           regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'),
               '(^|[^\\p{L}\\p{N}_])(inc|llc|ltd|gmbh|bv|ab|oy|corp|co|the|a|an)([^\\p{L}\\p{N}_]|$)', '', 'g'), '[^a-z0-9]+', '', 'g') AS name,
           CASE WHEN length(text) <= 21 THEN text ELSE left(text, 9) || '...' || right(text, 9) END AS short FROM documents
""")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, names for comparison and shortened forms of all titles."""
    docs = table(spark, sf_dir, "documents")
    head = F.substring("text", 1, 40)
    return docs.select("doc_id", T.slug(head).alias("slug"), T.normal_name(head).alias("name"), T.truncate_middle(F.col("text"), 21).alias("short"))


@query("""
    WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS token FROM documents WHERE text IS NOT NULL),
    df AS (SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY token)
    SELECT token, df, tf, round(ln((SELECT count(*) FROM documents) / df::DOUBLE), 9) AS idf FROM df
""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequencies of all tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    per_doc = docs.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) > 2)).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).crossJoin(F.broadcast(total)).select("token", "df", "tf", F.round(F.log(F.col("docs") / F.col("df")), 9).alias("idf"))


@query("""
    WITH topic AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS words FROM benchmark),
    tw AS (SELECT item_id, unnest(words) AS token FROM topic), n AS (SELECT count(*) AS n FROM topic),
    idf AS (SELECT token, ln(n.n / count(*)::DOUBLE) AS idf FROM tw, n GROUP BY token, n.n),
    d AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS token FROM documents) GROUP BY 1, 2),
    dn AS (SELECT doc_id, sqrt(sum(pow(tf * coalesce(idf, 1.0), 2))) AS norm FROM d LEFT JOIN idf USING (token) GROUP BY doc_id),
    tn AS (SELECT item_id, sqrt(sum(pow(idf, 2))) AS norm FROM tw JOIN idf USING (token) GROUP BY item_id),
    x AS (SELECT doc_id, item_id, sum(tf * idf * idf) AS dot FROM d JOIN tw USING (token) JOIN idf USING (token) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, CAST(floor(round(100 * dot / (dn.norm * tn.norm), 6) + 0.5) AS BIGINT) AS score FROM x JOIN dn USING (doc_id) JOIN tn USING (item_id)
    WHERE dn.norm * tn.norm > 0 AND floor(round(100 * dot / (dn.norm * tn.norm), 6) + 0.5) > 5
""")
def tfidf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against topics by cosine of weighted terms; tokens of no topic weigh 1."""
    from siltwork.operators.similarity import topic_scores

    return topic_scores(dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query("""
    SELECT event_id, printf('%08x', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(props, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT) AS hash,
        nullif(regexp_extract(props, '(?s)\\{.*\\}'), '') AS object FROM events
""")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit hashes and the widest braces of events' properties."""
    return table(spark, sf_dir, "events").select("event_id", T.fnv32(F.col("props")).alias("hash"), T.json_object(F.concat(F.lit("so: "), "props", F.lit(" done"))).alias("object"))


@query("""
    WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, event_type AS first_type, n FROM r WHERE n = 1
""")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("event_type").alias("first_type"), F.col("n").cast("long").alias("n"))


@query("""
    WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations), m AS (SELECT *, lower(t) AS low FROM t WHERE t <> '')
    SELECT 'chat' || conv_id AS chat, count(*) AS messages, count(*) FILTER (WHERE conv_id % 2 = 1) AS added, count(*) FILTER (WHERE contains(low, 'the') OR contains(low, '!!') OR regexp_matches(t, 'https?://\\S+')) AS promoted, min(sha256(t)) AS least FROM m GROUP BY conv_id
""")
def chat_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chat exports parsed: all messages are stored once, and those that carry a lead become candidates."""
    from siltwork.operators.tables import new_rows
    from siltwork.sources.chats import parse_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    line = F.concat(F.lit("[2026-09-12, 10:"), F.lpad(F.col("turn") % 60, 2, "0"), F.lit(":00] "), "role", F.lit(": "), F.coalesce("t", F.lit("")))
    lines = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    messages = parse_chats(lines.select(F.concat(F.lit("chat"), "conv_id").alias("chat"), "raw")).withColumn("row", F.concat_ws("|", "chat", F.col("line_no").cast("string")))
    stored = messages.where(F.substring("chat", 5, 20).cast("long") % 2 == 0)
    new = new_rows(messages, stored.select("row"), "row", "line_no").groupBy("chat").agg(F.count(F.lit(1)).alias("added"))
    lead = T.is_lead(F.col("text"), ("the", "!!"))
    all_ = messages.groupBy("chat").agg(F.count(F.lit(1)).alias("messages"), F.count_if(lead).alias("promoted"), F.min(F.sha2("text", 256)).alias("least"))
    return all_.join(new, "chat", "left").select("chat", "messages", F.coalesce("added", F.lit(0)).alias("added"), "promoted", "least")


@query("""
    WITH k(topic, words) AS (VALUES ('agents', ['agent', 'automation', 'workflow']), ('industry', ['manufacturing', 'supply', 'logistics']), ('health', ['health', 'clinical', 'patient']), ('finance', ['payments', 'compliance', 'ledger'])),
    d AS (SELECT doc_id, lower(substr(text, 1, 30) || [' agent workflow agent', ' supply chain', ' patient ledger', ''][doc_id % 4 + 1]) AS t FROM documents),
    tok AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS token FROM d) GROUP BY ALL),
    tw AS (SELECT topic, unnest(words) AS token FROM k), n AS (SELECT doc_id, sqrt(sum(pow(tf * CASE WHEN token IN (SELECT token FROM tw) THEN ln(4.0::DOUBLE) ELSE 1.0 END, 2))) AS norm FROM tok GROUP BY doc_id),
    x AS (SELECT doc_id, topic, sum(tf * ln(4.0::DOUBLE) * ln(4.0::DOUBLE)) AS dot FROM tok JOIN tw USING (token) GROUP BY ALL)
    SELECT doc_id, topic, CAST(floor(round(100 * dot / (norm * sqrt(3.0::DOUBLE) * ln(4.0::DOUBLE)), 6) + 0.5) AS BIGINT) AS score FROM x JOIN n USING (doc_id) WHERE floor(round(100 * dot / (norm * sqrt(3.0::DOUBLE) * ln(4.0::DOUBLE)), 6) + 0.5) > 5
""")
def topic_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts against the built-in table of topics."""
    from siltwork.operators.similarity import topic_scores
    from siltwork.sources.files import topics

    tails = F.array(*map(F.lit, (" agent workflow agent", " supply chain", " patient ledger", "")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 30), F.element_at(tails, (F.col("doc_id") % 4 + 1).cast("int"))).alias("text"))
    known = spark.createDataFrame([(name, " ".join(words)) for name, _, words in topics()], "topic string, text string")
    return topic_scores(docs, "doc_id", known, "topic")
