"""Reports, tables, memos and graphs of deals, and the decision models' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import profiles as P
from siltwork.functions import quant as Q
from siltwork.functions import text as T
from siltwork.operators import exports as X
from siltwork.operators import workbook as W
from siltwork.operators.ranking import ensure_checkpoint_dir
from siltwork.plans.frames import table
from siltwork.plans.profiles import PROFILES_SQL, STAGE_SQL, scored
from siltwork.plans.ranking import PENALTIES_SQL
from siltwork.plans.registry import query

FIELDS = (("startup_name", "Name", False), ("website", "Website", False), ("traction", "Traction", True))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("text")
    report = F.create_map(F.lit("startup_name"), F.when(n % 4 != 0, F.concat(F.lit("Co"), n)), F.lit("website"), F.when(n % 3 == 0, "").otherwise("https://x.io"), F.lit("traction"), F.when(n % 5 == 0, "n/a").when(n % 5 == 1, F.substring(text, 1, 20)))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.when(n % 6 != 0, n * 7 % 1009 / 1000).alias("score"), F.concat(F.lit("doc://"), n).alias("source_url"), report.alias("report"))


@query("""
    SELECT doc_id, '# ' || CASE WHEN doc_id % 4 = 0 THEN 'Unnamed' ELSE 'Co' || doc_id END || ' — Fund' || chr(10) || chr(10) || '**Name:** ' || CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'Co' || doc_id END || chr(10) || '**Website:** ' || CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'https://x.io' END
        || CASE WHEN doc_id % 5 = 1 AND substr(text, 1, 20) NOT IN ('', 'unknown', 'n/a') THEN chr(10) || '**Traction:** ' || substr(text, 1, 20) ELSE '' END AS report FROM documents
""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as Markdown, conditional fields hidden where nothing is known."""
    return reports(spark, sf_dir).select("doc_id", X.report_lines(F.col("report"), FIELDS, "Fund").alias("report"))


@query("""
    SELECT CASE WHEN doc_id % 6 = 0 THEN '' ELSE printf('%.3f', doc_id * 7 % 1009 / 1000.0::DOUBLE) END AS "Score", source AS "Source", 'doc://' || doc_id AS "Link", CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Co' || doc_id END AS "Name", CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://x.io' END AS "Website" FROM documents
""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fund's table: score, source, link and its own fields."""
    return X.report_table(reports(spark, sf_dir), F.col("report"), [(k, label) for k, label, _ in FIELDS[:2]])


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    ev = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("quote")) for c in ("name", "headline", "about", "company")]), lambda e: e["quote"] != "")
    dimensions = F.create_map(*[c for d in P.DIMENSIONS for c in (F.lit(d), F.col(d))])
    return s.withColumns({"deal_id": F.concat(F.lit("deal"), "doc_id"), "quotes": ev, "dimensions": dimensions, "stage": P.stage()["stage"], "summary": P.summary()})


@query(f"""
    WITH {PROFILES_SQL}, {STAGE_SQL}, dl AS (SELECT 'deal' || u.doc_id AS deal_id, u.*, k.stage AS deal_stage FROM u JOIN k USING (doc_id)),
    ev AS (SELECT deal_id, unnest(list_filter([{{'f': 'name', 'q': name}}, {{'f': 'headline', 'q': headline}}, {{'f': 'about', 'q': about}}, {{'f': 'company', 'q': company}}], lambda e: e.q <> '')) AS e, generate_subscripts(list_filter([name, headline, about, company], lambda q: q <> ''), 1) - 1 AS id FROM dl),
    sg AS (SELECT deal_id, unnest(signals) AS s FROM dl)
    SELECT 'people' AS export, deal_id, '' AS part, sha256(concat_ws('|', name, headline, company, recommendation, total)) AS value_sha256 FROM dl
    UNION ALL SELECT 'companies', deal_id, '', sha256(concat_ws('|', company, website, deal_stage)) FROM dl WHERE company <> '' OR website <> ''
    UNION ALL SELECT 'evidence', deal_id, CAST(id AS VARCHAR), sha256(e.f || '|' || e.q) FROM ev
    UNION ALL SELECT 'signals', deal_id, string_split(s, '|')[1], sha256(string_split(s, '|')[2]) FROM sg
    UNION ALL SELECT 'scorecard', deal_id, dimension, sha256(CAST(score AS VARCHAR)) FROM (UNPIVOT (SELECT deal_id, founder_likelihood, collaborative_edge, structural_demand, mutual_value, technical_credibility, market_pain, market_timing, investor_fit, outreach_urgency, red_flag_risk, data_quality FROM dl) ON COLUMNS(* EXCLUDE deal_id) INTO NAME dimension VALUE score)
""")
def deal_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that nested deals come apart into, each row with a digest of its values."""
    d = deals(spark, sf_dir)
    evidence = F.transform("quotes", lambda e, i: F.struct(i.cast("string").alias("id"), e["field"].alias("field"), e["quote"].alias("quote")))
    ensure_checkpoint_dir(spark)
    # Scored once and stored: each of the tables would score all profiles again.
    stored = d.select("deal_id", "name", "headline", "company", "website", "stage", "total", "recommendation", "dimensions", "signals", evidence.alias("evidence")).checkpoint()
    shown = {
        "people": ("", ("name", "headline", "company", "recommendation", "total")),
        "companies": ("", ("company", "website", "stage")),
        "evidence": ("id", ("field", "quote")),
        "signals": ("label", ("words",)),
        "scorecard": ("dimension", ("score",)),
    }
    out = None
    for name, rows in X.tables_of(stored).items():
        part, values = shown[name]
        digest = F.sha2(F.concat_ws("|", *[F.col(v).cast("string") for v in values]), 256)
        one = rows.select(F.lit(name).alias("export"), "deal_id", (F.col(part) if part else F.lit("")).alias("part"), digest.alias("value_sha256"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT source AS name, round(avg(n_chars), 2) AS mean, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source UNION ALL
    SELECT 'average', round(avg(mean), 2), round(avg(n), 2) FROM (SELECT round(avg(n_chars), 2) AS mean, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source)
""")
def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of sources with the row of averages below."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.round(F.avg("n_chars"), 2).alias("mean"), F.count(F.lit(1)).alias("n"))
    return X.with_average(rows, "name", ["mean", "n"])


@query("""
    WITH d AS (SELECT doc_id, list_filter([{'f': 'name', 'q': 'Person ' || doc_id}, {'f': 'text', 'q': substr(text, 1, 200)}, {'f': 'more', 'q': CASE WHEN doc_id % 2 = 0 THEN '' ELSE substr(text, 201, 30) END}], lambda e: e.q <> '') AS e FROM documents),
    m AS (SELECT *, list_transform(e, lambda x, i: '[^' || i || ']: ' || x.f || ': ' || CASE WHEN length(x.q) <= 80 THEN x.q ELSE left(x.q, 39) || '...' || right(x.q, 38) END) AS foot FROM d)
    SELECT doc_id, sha256('# Person ' || doc_id || ' memo' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || 'A summary.' || array_to_string(list_transform(e[1:3], lambda x, i: '[^' || i || ']'), '') || chr(10) || chr(10) || '## Recommendation' || chr(10) || chr(10) || 'monitor' || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || array_to_string(foot, chr(10))) AS memo_sha256 FROM m
""")
def deal_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos with footnotes of their evidence."""
    n, text = F.col("doc_id"), F.col("text")
    parts = [("name", F.concat(F.lit("Person "), n)), ("text", F.substring(text, 1, 200)), ("more", F.when(n % 2 == 0, "").otherwise(F.substring(text, 201, 30)))]
    notes = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), q.alias("quote")) for f, q in parts]), lambda e: e["quote"] != "")
    deal = {"name": parts[0][1], "summary": F.lit("A summary."), "recommendation": F.lit("monitor")}
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.memo(deal, notes), 256).alias("memo_sha256"))


GRAPH_SQL = """
d AS (SELECT 'deal' || doc_id AS deal_id, 'person:deal' || doc_id AS f, CASE WHEN doc_id % 3 <> 0 THEN 'company:co' || (doc_id % 50) END AS c, doc_id, least(1.0, (doc_id % 200) / 100.0)::DOUBLE AS score, substr(text, 1, 10) AS t FROM documents),
e AS (
    SELECT deal_id, f AS s, c AS t, 'FOUNDER_OF' AS type FROM d WHERE c IS NOT NULL
    UNION ALL SELECT deal_id, f, 'roles:role ' || (i % 10), 'WORKED_AT' FROM d, range(doc_id % 12) r(i) WHERE i < 8
    UNION ALL SELECT deal_id, coalesce(c, f), 'competitors:rival ' || (i % 3), 'COMPETES_WITH' FROM d, range(doc_id % 10) r(i) WHERE i < 8
    UNION ALL SELECT deal_id, 'investors:fund ' || i, coalesce(c, f), 'INVESTED_IN' FROM d, range(doc_id % 14) r(i) WHERE i < 12)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("doc_id")
    none = F.array().cast("array<string>")

    def listed(word: str, modulo: int, most: int) -> F.Column:
        numbers = F.sequence(F.lit(0), (n % most - 1).cast("int"))
        return F.when(n % most > 0, F.transform(numbers, lambda i: F.concat(F.lit(f"{word} "), i % modulo))).otherwise(none)

    families = {f: none for f in X.FAMILIES} | {"roles": listed("Role", 10, 12), "competitors": listed("Rival", 3, 10), "investors": listed("Fund", 100, 14)}
    given = table(spark, sf_dir, "documents").select(F.concat(F.lit("deal"), n).alias("deal_id"), F.concat(F.lit("P"), n).alias("name"), F.when(n % 3 != 0, F.concat(F.lit("Co"), n % 50)).alias("company"), (n % 200).alias("founder_score"), *[c.alias(f) for f, c in families.items()])
    return X.evidence_graph(given)


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT deal_id, s || '_' || type || '_' || t AS id, s AS source, t AS target, type FROM e WHERE s <> t")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the evidence graph of each deal, each once."""
    return graph(spark, sf_dir)[1].select("deal_id", "id", "source", "target", "type")


@query(f"""
    WITH {GRAPH_SQL}, n AS (SELECT deal_id, f AS id, 'founder' AS type FROM d UNION SELECT deal_id, s, 'x' FROM e WHERE type = 'INVESTED_IN' UNION SELECT deal_id, t, CASE type WHEN 'WORKED_AT' THEN 'company' WHEN 'FOUNDER_OF' THEN 'company' ELSE 'y' END FROM e WHERE type <> 'INVESTED_IN')
    SELECT deal_id, count(*) AS nodes, count(*) FILTER (WHERE type IN ('founder', 'company')) AS shown, (SELECT count(DISTINCT s || type || t) FROM e WHERE e.deal_id = n.deal_id AND type IN ('FOUNDER_OF', 'WORKED_AT')) AS shown_edges FROM n GROUP BY deal_id
""")
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each deal's graph, and what a filter on two types shows of it."""
    nodes, edges = graph(spark, sf_dir)
    kept, shown = X.visible(nodes, edges, ("founder", "company"))
    total = nodes.groupBy("deal_id").agg(F.count(F.lit(1)).alias("nodes"))
    some = kept.groupBy("deal_id").agg(F.count(F.lit(1)).alias("shown"))
    lines = shown.groupBy("deal_id").agg(F.count(F.lit(1)).alias("shown_edges"))
    return total.join(some, "deal_id").join(lines, "deal_id", "left").na.fill(0, ["shown_edges"])


@query(f"""
    WITH {GRAPH_SQL}, n AS (SELECT deal_id, f AS id FROM d UNION SELECT deal_id, s FROM e UNION SELECT deal_id, t FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY deal_id) AS n FROM n WHERE NOT starts_with(id, 'person:'))
    SELECT deal_id, id, round(450 + 342 * cos(2 * pi() * k / n), 2) AS x, round(310 + 235.6 * sin(2 * pi() * k / n), 2) AS y FROM k UNION ALL SELECT deal_id, f, 450.0::DOUBLE, 310.0::DOUBLE FROM d
""")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.graph_places(graph(spark, sf_dir)[0])


@query(f"WITH {GRAPH_SQL}, n AS (SELECT deal_id, f AS id FROM d UNION SELECT deal_id, s FROM e UNION SELECT deal_id, t FROM e) SELECT deal_id, count(*) AS nodes, (SELECT count(DISTINCT s || type || t) FROM e WHERE e.deal_id = n.deal_id) AS edges, min(id) AS first FROM n GROUP BY deal_id")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as JSON, read back."""
    g = X.graph_json(*graph(spark, sf_dir))
    back = F.from_json("graph", "nodes array<struct<id:string>>, edges array<struct<id:string>>")
    return g.select("deal_id", back.alias("g")).select("deal_id", F.size("g.nodes").cast("long").alias("nodes"), F.size("g.edges").cast("long").alias("edges"), F.col("g.nodes")[0]["id"].alias("first"))


@query("SELECT DISTINCT 'c' || conv_id AS claim_id, conv_id * 100 + turn AS evidence_id, role AS field FROM conversations WHERE turn % 2 = 0")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and the evidence that they list; ids of nothing are left out."""
    t = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 100 + F.col("turn")
    claims = t.where("turn % 2 = 0").groupBy(F.concat(F.lit("c"), "conv_id").alias("claim_id")).agg(F.concat(F.collect_list(number), F.array(F.lit(-1).cast("long"))).alias("evidence_ids"))
    return X.joined_claims(claims, t.select(number.alias("evidence_id"), F.col("role").alias("field")))


@query("SELECT 'deal' || (event_id % 50) AS deal_id, 'r' || event_id AS run_id, user_id % 3 AS version FROM events WHERE event_id % 50 < 40 AND event_id % 4 <> 0")
def deal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of known deals, found by a tag, and the version in another tag."""
    e = F.col("event_id")
    tags = F.array_compact(F.array(F.lit("note"), F.when(e % 4 != 0, F.concat(F.lit("dealId:deal"), e % 50)), F.concat(F.lit("version:"), F.col("user_id") % 3)))
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), e).alias("run_id"), F.col("ts").alias("created_at"), tags.alias("tags"))
    known = spark.range(40).select(F.concat(F.lit("deal"), "id").alias("deal_id"))
    found = X.runs_of(runs, known)
    version = runs.select("run_id", X.tag_value(F.col("tags"), "version:").cast("long").alias("version"))
    return found.join(version, "run_id").select("deal_id", "run_id", "version")


@query("SELECT 'd' || user_id AS deal_id, max_by(event_id, (ts, event_id % 2, event_id)) AS payload, max(ts) AS updated_at FROM events GROUP BY user_id")
def deal_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each deal the latest update out of what is stored and what comes."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), "user_id").alias("deal_id"), F.col("event_id").alias("payload"), F.col("ts").alias("updated_at"))
    latest = lambda rows: rows.groupBy("deal_id").agg(F.max_by("payload", F.struct("updated_at", "payload")).alias("payload"), F.max("updated_at").alias("updated_at"))
    return X.saved(latest(e.where("payload % 2 = 0")), latest(e.where("payload % 2 = 1")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, len(embedding) AS size FROM embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as packed bytes of 32-bit floats, and back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    back = T.unpacked(T.packed(e, "vec_id", "embedding"), "vec_id", "embedding")
    return back.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.size("embedding").alias("size"))


@query("""
    WITH s AS (SELECT n, alpha FROM (VALUES (1.5), (2.5), (0.8)) a(alpha), (VALUES (20), (40)) b(n)), r AS (SELECT i AS place, least(1.0, 0.1 * pow(i, -0.35)) AS p FROM range(1, 201) t(i)), m AS (SELECT avg(p) AS mean FROM r),
    q AS (SELECT n, alpha, sum(ln(1 - p * pow(n::DOUBLE, -alpha))) AS good, sum(ln(1 - mean * pow(n::DOUBLE, -alpha))) AS blind FROM s JOIN r ON place <= n, m GROUP BY n, alpha)
    SELECT CAST(n AS INTEGER) AS n, CAST(alpha AS DOUBLE) AS alpha, round(exp(blind) - exp(good), 9) AS lift, alpha > 1 AS mean, alpha > 2 AS variance FROM q
""")
def screening_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What perfect ranking adds to the odds at a given size, and which moments the tail leaves."""
    out = None
    for n in (20, 40):
        for alpha in (1.5, 2.5, 0.8):
            m = Q.moments_exist(F.lit(alpha))
            one = spark.range(1).select(F.lit(n).alias("n"), F.lit(alpha).alias("alpha"), F.round(Q.any_hit(n, 1.0, alpha) - Q.any_hit(n, 0.0, alpha), 9).alias("lift"), m["mean"].alias("mean"), m["variance"].alias("variance"))
            out = one if out is None else out.unionByName(one)
    return out


@query(f"""
    WITH {PENALTIES_SQL}, sh(channel, q) AS (VALUES ('whatsapp', 0.70), ('linkedin', 0.60), ('github', 0.50), ('hackernews', 0.45), ('reddit', 0.35), ('substack', 0.30), ('inbound', 0.25), ('other', 0.40)),
    z0 AS (SELECT channel, CAST(q AS DOUBLE) AS q, min_by(x, abs(f - q)) AS x, min_by(f, abs(f - q)) AS f, min_by(p, abs(f - q)) AS p FROM sh, gf GROUP BY channel, q),
    z AS (SELECT channel, q, x - (f - q) / p / (1 + x * (f - q) / p / 2) AS z FROM z0), mi AS (SELECT channel, exp(-z * z / 2) / sqrt(2 * pi()) / q AS mills FROM z),
    ed AS (SELECT channel, (SELECT penalty_alike FROM pe WHERE channel = 'hackernews') - penalty_alike AS edge FROM pe),
    en AS (SELECT n, 9 - sum((CASE WHEN i IN (0, 3600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.005::DOUBLE / 3 * pow(f, n)) AS e FROM range(1, 61) r(n), gf GROUP BY n)
    SELECT channel, round(0.125 * (mills - (SELECT mills FROM mi WHERE channel = 'github')), 6) AS penalty, round(edge, 6) AS edge,
        CAST(CASE WHEN edge <= 0 THEN 1 ELSE (SELECT max(n) FROM en WHERE e <= edge / (0.0625 / 0.085 * 0.15)) END AS INTEGER) AS audience FROM mi JOIN ed USING (channel)
""")
def selection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What being in a channel says about quality, its edge over the most public one and the audience that undoes it."""
    found = Q.selection_by_channel()
    rows = [(c or "other", round(v, 6), round(Q.exclusivity_edge(c, "hackernews"), 6), Q.break_even_audience(max(0.0, Q.exclusivity_edge(c, "hackernews")))) for c, v in found.items()]
    return spark.createDataFrame(rows, "channel string, penalty double, edge double, audience int")


@query("SELECT doc_id, list_distinct(['lead', source, lang, 'lead']) IS NOT NULL AS tagged, len(list_distinct(['lead', source, lang, 'lead'])) AS n, CASE WHEN doc_id % 3 = 0 THEN 0.35 ELSE doc_id % 10 / 10.0 END::DOUBLE AS threshold FROM documents")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags united in order, and a setting filled from the defaults."""
    d = table(spark, sf_dir, "documents")
    tags = F.array_distinct(F.concat(F.array(F.lit("lead"), "source"), F.array("lang", F.lit("lead"))))
    own = F.from_json(F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct((F.col("doc_id") % 10 / 10).alias("threshold")))), "threshold double")
    return d.select("doc_id", tags.isNotNull().alias("tagged"), F.size(tags).cast("long").alias("n"), F.coalesce(own["threshold"], F.lit(0.35)).alias("threshold"))


@query(f"""
    WITH {PROFILES_SQL}, dl AS (SELECT *, CAST(floor(confidence * 100 + 0.5) / 100.0 AS DOUBLE) AS sure, row_number() OVER (PARTITION BY recommendation ORDER BY total DESC, doc_id) AS place FROM u),
    rw AS (SELECT recommendation AS fund, 'Summary' AS sheet, place, name || '|' || CAST(total AS DOUBLE) || '|' || sure || '|' || CAST(red_flag_risk AS DOUBLE) || '|' || replace(recommendation, '_', ' ') AS line FROM dl
        UNION ALL SELECT recommendation, 'Summary', 1000000000, 'Averages|' || floor(avg(total) * 100 + 0.5) / 100 || '|' || floor(avg(sure) * 100 + 0.5) / 100 || '|' || floor(avg(red_flag_risk) * 100 + 0.5) / 100 || '|' FROM dl GROUP BY recommendation
        UNION ALL SELECT recommendation, 'People', doc_id, 'deal' || doc_id || '|' || name || '|' || company FROM dl WHERE company <> '')
    SELECT fund, sheet, count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY place)) AS cells_sha256 FROM rw GROUP BY fund, sheet
""")
def deal_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per tier, written and read back in tasks: a summary with averages, and people."""
    ensure_checkpoint_dir(spark)
    s = scored(spark, sf_dir).select("doc_id", "name", "company", "total", "red_flag_risk", "recommendation", (F.floor(F.col("confidence") * 100 + 0.5) / 100).alias("sure")).checkpoint()
    summary = W.sheet(s, "recommendation", [F.desc("total"), F.col("doc_id")], [W.text_cell(F.col("name")), W.number_cell(F.col("total"), W.SCORE_COLOURS), W.number_cell(F.col("sure")), W.number_cell(F.col("red_flag_risk"), W.RISK_COLOURS), W.text_cell(F.replace("recommendation", F.lit("_"), F.lit(" ")))])
    people = W.sheet(s.where("company != ''"), "recommendation", [F.col("doc_id")], [W.text_cell(F.concat(F.lit("deal"), "doc_id")), W.text_cell(F.col("name")), W.text_cell(F.col("company"))])
    books = W.workbooks([("Summary", ("Founder", "Total", "Confidence", "Risk", "Recommendation"), W.with_averages(summary, (1, 2, 3))), ("People", ("Deal", "Name", "Company"), people)])
    return W.sheet_digests(books)
