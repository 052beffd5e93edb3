"""Profiles made from documents: features, dimensions, tiers, findings, deals and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import profiles as P
from siltwork.plans.frames import dealt, table
from siltwork.plans.registry import query

HEADS = (" founder building an AI agent for compliance", " student exploring ideas", " stealth", " software engineer, we raised pre-seed", " show hn: our launched API, hiring", "")
SOURCES = ("https://github.com/x", "https://www.linkedin.com/in/x", "https://sifted.eu/a", "https://acme.com/", "")

#: The same frame for the oracles, which state all words and weights on their own.
PROFILES_SQL = """
p AS (
    SELECT doc_id, 'Person ' || doc_id AS name, substr(text, 1, 60) || [' founder building an AI agent for compliance', ' student exploring ideas', ' stealth', ' software engineer, we raised pre-seed', ' show hn: our launched API, hiring', ''][doc_id % 6 + 1] AS headline,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 60, 300) END AS about, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Co' || (doc_id % 50) END AS company,
        CASE WHEN doc_id % 5 = 0 THEN 'https://co' || doc_id || '.io' ELSE '' END AS website, substr(text, 400, 2000) AS raw,
        CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN [substr(text, 361, 40)] ELSE [substr(text, 361, 40), 'Software Engineer'] END AS experience,
        CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['We are hiring'] ELSE [substr(text, 401, 50), 'launched a beta'] END AS posts,
        CASE WHEN doc_id % 2 = 0 THEN [] ELSE ['Uni'] END AS education, CASE WHEN doc_id % 5 = 1 THEN ['sql', 'rust'] ELSE [] END AS skills,
        CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['https://github.com/u' || doc_id] WHEN 2 THEN ['https://www.linkedin.com/in/p', 'https://p' || doc_id || '.dev'] ELSE ['news.ycombinator.com/item'] END AS links,
        doc_id % 7 = 0 AS github_name, ['https://github.com/x', 'https://www.linkedin.com/in/x', 'https://sifted.eu/a', 'https://acme.com/', ''][doc_id % 5 + 1] AS source_url,
        CASE WHEN doc_id % 11 = 0 THEN 'official_api' ELSE '' END AS source_type, doc_id % 2 = 0 AS pasted FROM documents),
c AS (SELECT *, lower(array_to_string(list_filter([name, headline, about, company, website, raw], lambda x: x <> '') || list_filter(experience || education || skills || posts || links, lambda x: x <> ''), ' ')) AS low FROM p),
h AS (SELECT *,
    list_filter(['ai','artificial intelligence','llm','agent','agents','machine learning','ml','automation','copilot','workflow','reasoning','model','data'], lambda x: contains(low, x)) AS ai,
    list_filter(['b2b','enterprise','workflow','platform','saas','developer','infrastructure','compliance','finance','ops','supply chain','sales','security','hr'], lambda x: contains(low, x)) AS b2b,
    list_filter(['founder','co-founder','cofounder','founding','ceo','cto','stealth founder','startup founder'], lambda x: contains(low, x)) AS founder,
    list_filter(['building','built','launched','demo','beta','waitlist','github','api','open source','product','release','ship','shipping'], lambda x: contains(low, x)) AS builder,
    list_filter(['manual','pain','broken','slow','expensive','inefficient','fragmented','compliance','legacy','spreadsheet','workaround','labor shortage'], lambda x: contains(low, x)) AS pain,
    list_filter(['fundraising','pre-seed','preseed','seed','angel','investor','vc','accelerator','yc','techstars','raise'], lambda x: contains(low, x)) AS investor,
    list_filter(['turkey','turkish','istanbul','ankara','immigrant','diaspora','us market','u.s.','united states','cross-border','global','san francisco','new york','amsterdam','europe'], lambda x: contains(low, x)) AS crossb,
    list_filter(['stealth','advisor','consultant','fractional','student','aspiring','exploring','idea','coming soon'], lambda x: contains(low, x)) AS risk FROM c),
f AS (SELECT *, 1 + CAST(trim(headline) <> '' AS INT) + CAST(trim(about) <> '' AS INT) + CAST(company <> '' AS INT) + CAST(trim(array_to_string(experience, chr(10))) <> '' AS INT) + CAST(trim(array_to_string(posts, chr(10))) <> '' AS INT) + CAST(len(links) > 0 AS INT) AS n_ev,
    CAST(company <> '' OR website <> '' AS DOUBLE) AS has_company, CAST(website <> '' OR len(list_filter(links, lambda x: NOT contains(x, 'linkedin.com') AND regexp_matches(x, '^https?://'))) > 0 AS DOUBLE) AS has_site,
    CAST(github_name OR contains(low, 'github.com') AS DOUBLE) AS has_github, CAST(contains(low, 'news.ycombinator.com') OR contains(low, 'show hn') AS DOUBLE) AS has_hn,
    CAST(len(list_filter(experience, lambda x: regexp_matches(x, '(?i)(^|[^A-Za-z0-9_])(engineer|engineering|cto|developer|technical|architect|software)([^A-Za-z0-9_]|$)'))) > 0 AS DOUBLE) AS technical_role,
    CAST(len(founder) = 0 AND contains(low, 'student') AS DOUBLE) AS student, least(len(founder) / 3.0::DOUBLE, 1) AS x_founder, least(len(builder) / 4.0::DOUBLE, 1) AS x_builder, least(len(pain) / 3.0::DOUBLE, 1) AS x_pain,
    least(len(investor) / 3.0::DOUBLE, 1) AS x_investor, least(len(crossb) / 3.0::DOUBLE, 1) AS x_cross, least(len(risk) / 3.0::DOUBLE, 1) AS x_risk, least(len(ai) / 3.0::DOUBLE, 1) AS x_ai, least(len(b2b) / 3.0::DOUBLE, 1) AS x_b2b,
    least(len(posts) / 5.0::DOUBLE, 1) AS x_posts, least(len(experience) / 3.0::DOUBLE, 1) AS x_experience, least(len(education) / 2.0::DOUBLE, 1) AS x_education, least(len(skills) / 3.0::DOUBLE, 1) AS x_skills, least(length(about) / 240.0::DOUBLE, 1) AS x_about,
    least(len(links) / 6.0::DOUBLE, 1) AS x_links, greatest(CASE WHEN pasted THEN 0.75 ELSE 0.5 END, CASE WHEN source_url = '' THEN 0.0 WHEN source_type <> '' THEN 1.0 WHEN doc_id % 5 = 3 THEN 1.0 WHEN doc_id % 5 = 0 THEN 1.0 WHEN doc_id % 5 = 1 THEN 0.75 ELSE 0.5 END)::DOUBLE AS reliability,
    CAST(contains(low, 'customer') OR contains(low, 'design partner') OR contains(low, 'paying user') AS DOUBLE) AS customer,
    CAST(contains(low, 'enterprise') OR contains(low, 'fortune') OR contains(low, 'gtm') OR contains(low, 'rfp') OR contains(low, 'procurement') AS DOUBLE) AS enterprise,
    CAST(contains(low, 'launch') OR contains(low, 'ship') OR contains(low, 'release') OR contains(low, 'public beta') AS DOUBLE) AS launch, CAST(contains(low, 'hiring') OR contains(low, 'open roles') OR contains(low, 'careers') AS DOUBLE) AS hiring,
    CAST(contains(low, 'yc') OR contains(low, 'y combinator') AS DOUBLE) AS yc FROM h),
g AS (SELECT *, least(n_ev / 6.0::DOUBLE, 1) AS x_evidence, CAST(contains(low, 'stealth') AND has_site = 0 AND has_company = 0 AS DOUBLE) AS stealth FROM f),
d0 AS (SELECT *, CAST(floor(100 / (1 + exp(-(-0.6 + 0.5 * has_company + 0.4 * has_site + 0.4 * has_github + 0.4 * has_hn + 0.4 * x_founder + 0.3 * x_builder - 0.7 * student - 0.5 * stealth))) + 0.5) AS BIGINT) AS founder_likelihood FROM g),
d AS (SELECT *,
    CAST(floor(100 / (1 + exp(-(-0.4 + 0.5 * has_company + 0.4 * has_site + 0.5 * x_founder + 0.3 * x_cross + 0.2 * x_posts))) + 0.5) AS BIGINT) AS collaborative_edge,
    CAST(floor(100 / (1 + exp(-(-0.5 + 0.6 * x_ai + 0.5 * x_b2b + 0.4 * x_pain + 0.3 * has_company))) + 0.5) AS BIGINT) AS structural_demand,
    CAST(floor(100 / (1 + exp(-(-0.4 + 0.4 * x_about + 0.25 * x_experience + 0.2 * x_education + 0.5 * has_site + 0.3 * x_evidence))) + 0.5) AS BIGINT) AS mutual_value,
    CAST(floor(100 / (1 + exp(-(-0.4 + 0.4 * x_builder + 0.5 * has_github + 0.3 * x_skills + 0.4 * technical_role))) + 0.5) AS BIGINT) AS technical_credibility,
    CAST(floor(100 / (1 + exp(-(-0.5 + 0.5 * x_pain + 0.4 * x_b2b + 0.3 * customer + 0.3 * enterprise))) + 0.5) AS BIGINT) AS market_pain,
    CAST(floor(100 / (1 + exp(-(-0.3 + 0.4 * has_hn + 0.3 * yc + 0.4 * x_ai + 0.3 * launch))) + 0.5) AS BIGINT) AS market_timing,
    CAST(floor(100 / (1 + exp(-(-0.3 + 0.4 * x_investor + 0.3 * x_cross + 0.3 * x_b2b + 0.3 * x_ai))) + 0.5) AS BIGINT) AS investor_fit,
    CAST(floor(100 / (1 + exp(-(-0.3 + 0.4 * launch + 0.3 * hiring + 0.4 * x_investor + 0.3 * x_posts))) + 0.5) AS BIGINT) AS outreach_urgency,
    CAST(floor(100 / (1 + exp(-(-1.0 + 0.5 * x_risk + 0.5 * CAST(founder_likelihood < 35 AS INT) + 0.4 * (1 - has_company) + 0.3 * (1 - has_site)))) + 0.5) AS BIGINT) AS red_flag_risk,
    CAST(floor(100 / (1 + exp(-(-0.4 + 0.35 * x_evidence + 0.2 * x_links + 0.3 * CAST(about <> '' AS INT) + 0.3 * CAST(len(experience) > 0 AS INT) + 0.4 * reliability))) + 0.5) AS BIGINT) AS data_quality FROM d0),
s AS (SELECT *, list_filter([
    CASE WHEN len(ai) > 0 THEN 'AI-native vocabulary|' || array_to_string(ai[1:5], ', ') || '|' || CASE WHEN trim(about) <> '' THEN 'about' ELSE '' END END,
    CASE WHEN len(founder) > 0 THEN 'Founder/operator language|' || array_to_string(founder[1:5], ', ') || '|' || CASE WHEN trim(headline) <> '' THEN 'headline' ELSE '' END END,
    CASE WHEN len(b2b) + len(pain) > 0 THEN 'B2B pain surface|' || array_to_string((b2b || pain)[1:6], ', ') || '|' || CASE WHEN trim(about) <> '' THEN 'about' ELSE '' END END,
    CASE WHEN has_site > 0 THEN 'Public proof link|company website or non-LinkedIn public link|' || CASE WHEN len(links) > 0 THEN 'links' ELSE '' END END,
    CASE WHEN len(risk) > 0 OR stealth > 0 THEN 'Risk language|' || array_to_string((risk || CASE WHEN stealth > 0 THEN ['stealth flag'] ELSE [] END)[1:5], ', ') || '|' || CASE WHEN trim(about) <> '' THEN 'about' ELSE '' END END,
    CASE WHEN len(builder) > 0 THEN 'Builder proof language|' || array_to_string(builder[1:5], ', ') || '|' || CASE WHEN trim(about) <> '' THEN 'about' ELSE '' END END,
    CASE WHEN len(investor) > 0 THEN 'Fundraising or investor context|' || array_to_string(investor[1:4], ', ') || '|' || CASE WHEN trim(array_to_string(posts, chr(10))) <> '' THEN 'posts' ELSE '' END END,
    CASE WHEN len(crossb) > 0 THEN 'Cross-border fit|' || array_to_string(crossb[1:5], ', ') || '|' || CASE WHEN trim(about) <> '' THEN 'about' ELSE '' END END], lambda x: x IS NOT NULL) AS signals FROM d),
t AS (SELECT *, least(1.0, greatest(0.0, pow(data_quality / 100.0, 0.9) * (0.5 + 0.5 * CASE WHEN len(signals) = 0 THEN 0.0 ELSE len(list_filter(signals, lambda x: NOT suffix(x, '|'))) / len(signals)::DOUBLE END) * (0.5 + 0.5 * reliability) * x_evidence))::DOUBLE AS confidence,
    least(100, greatest(0, CAST(floor((0.18 * collaborative_edge + 0.18 * structural_demand + 0.12 * mutual_value + 0.14 * technical_credibility + 0.13 * market_pain + 0.11 * investor_fit + 0.14 * outreach_urgency) * (0.85 + 0.25 * data_quality / 100.0)::DOUBLE + 0.5) AS BIGINT))) AS total FROM s),
u AS (SELECT *, CASE WHEN total >= 80 AND confidence >= 0.65 AND red_flag_risk <= 40 THEN 'immediate_outreach' WHEN total >= 72 AND confidence >= 0.55 AND red_flag_risk <= 55 THEN 'take_meeting'
    WHEN total >= 64 AND confidence >= 0.5 AND red_flag_risk <= 70 THEN 'partner_review' WHEN total >= 42 AND confidence >= 0.3 AND red_flag_risk <= 85 THEN 'monitor' ELSE 'pass' END AS recommendation,
    CASE WHEN founder_likelihood >= 80 THEN 'confirmed_founder' WHEN founder_likelihood >= 60 THEN 'very_likely_founder' WHEN founder_likelihood >= 40 THEN 'possible_founder' WHEN founder_likelihood >= 20 THEN 'weak_signal' ELSE 'not_enough_evidence' END AS founder_label FROM t)"""


STAGE_SQL = """
w AS (SELECT doc_id, lower(concat_ws(' ', headline, about, raw, array_to_string(posts, ' '), array_to_string(experience, ' '))) AS t FROM p),
    k AS (SELECT doc_id, CASE WHEN contains(t, 'series a') OR contains(t, 'series b') OR contains(t, 'series c') OR contains(t, 'growth round') THEN 'series_a_plus' WHEN contains(t, ' seed ') OR contains(t, 'seed round') OR contains(t, 'seed-stage') THEN 'seed'
        WHEN contains(t, 'pre-seed') OR contains(t, 'preseed') OR contains(t, 'angel round') THEN 'pre_seed' WHEN contains(t, 'beta') OR contains(t, 'pilot') OR contains(t, 'demo') OR contains(t, 'launched') OR contains(t, 'public product') THEN 'mvp_beta'
        WHEN contains(t, 'waitlist') OR contains(t, 'coming soon') OR contains(t, 'landing page') THEN 'pre_product' WHEN contains(t, 'stealth') OR contains(t, 'building') OR contains(t, 'exploring') THEN 'idea_stealth' ELSE 'unknown' END AS stage FROM w)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of each document; what it lacks depends on its number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, text, none = F.col("doc_id"), F.col("text"), F.array().cast("array<string>")

    def one_of(values) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))

    job, post = F.substring(text, 361, 40), F.substring(text, 401, 50)
    github = F.array(F.concat(F.lit("https://github.com/u"), n))
    own = F.array(F.lit("https://www.linkedin.com/in/p"), F.concat(F.lit("https://p"), n, F.lit(".dev")))
    made = d.select(
        "doc_id",
        F.concat(F.lit("Person "), n).alias("name"),
        F.concat(F.substring(text, 1, 60), one_of(HEADS)).alias("headline"),
        F.lit("").alias("location"),
        F.when(n % 4 != 0, F.substring(text, 60, 300)).alias("about"),
        F.when(n % 3 != 0, F.concat(F.lit("Co"), n % 50)).alias("company"),
        F.when(n % 5 == 0, F.concat(F.lit("https://co"), n, F.lit(".io"))).alias("website"),
        F.lit(None).cast("string").alias("company_url"),
        F.substring(text, 400, 2000).alias("raw"),
        none.alias("current_roles"),
        none.alias("past_roles"),
        F.when(n % 3 == 1, F.array(job)).when(n % 3 == 2, F.array(job, F.lit("Software Engineer"))).alias("experience"),
        F.when(n % 2 == 1, F.array(F.lit("Uni"))).alias("education"),
        F.when(n % 5 == 1, F.array(F.lit("sql"), F.lit("rust"))).alias("skills"),
        F.when(n % 4 == 1, F.array(F.lit("We are hiring"))).when(n % 4 != 0, F.array(post, F.lit("launched a beta"))).alias("posts"),
        F.when(n % 4 == 1, github).when(n % 4 == 2, own).when(n % 4 == 3, F.array(F.lit("news.ycombinator.com/item"))).alias("links"),
        F.when(n % 7 == 0, F.array(F.concat(F.lit("u"), n))).alias("github_names"),
        none.alias("hn_names"),
        one_of(SOURCES).alias("source_url"),
        F.when(n % 11 == 0, "official_api").otherwise("").alias("source_type"),
        F.when(n % 2 == 0, "manual_paste").otherwise("visible_page").alias("mode"),
    )
    return dealt(made, "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_scores(P.with_features(profiles(spark, sf_dir)))


@query(f"""
    WITH {PROFILES_SQL} SELECT doc_id, sha256(low) AS corpus_sha256, CAST(n_ev AS BIGINT) AS n_evidence, round(x_founder + x_builder + x_pain + x_investor + x_cross + x_risk + x_ai + x_b2b, 9) AS words,
        round(x_posts + x_experience + x_education + x_skills + x_about + x_links + x_evidence, 9) AS amounts, CAST(has_company + 2 * has_site + 4 * has_github + 8 * has_hn + 16 * technical_role + 32 * student + 64 * stealth + 128 * customer
        + 256 * enterprise + 512 * launch + 1024 * hiring + 2048 * yc AS BIGINT) AS flags, round(reliability, 9) AS reliability FROM g
""")
def profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of profiles: sums of the word and amount shares, and the flags as bits."""
    f = P.with_features(profiles(spark, sf_dir))
    flags = ("has_company", "has_site", "has_github", "has_hn", "technical_role", "student", "stealth", "customer", "enterprise", "launch", "hiring", "yc")
    words, amounts = ("founder", "builder", "pain", "investor", "cross_border", "risk", "ai", "b2b"), ("posts", "experience", "education", "skills", "about_richness", "links", "evidence")
    return f.select(
        "doc_id",
        F.sha2("corpus", 256).alias("corpus_sha256"),
        F.col("n_evidence").cast("long").alias("n_evidence"),
        F.round(sum((F.col(f"f_{w}") for w in words), F.lit(0.0)), 9).alias("words"),
        F.round(sum((F.col(f"f_{a}") for a in amounts), F.lit(0.0)), 9).alias("amounts"),
        sum((F.col(f"f_{k}") * (1 << i) for i, k in enumerate(flags)), F.lit(0.0)).cast("long").alias("flags"),
        F.round("f_reliability", 9).alias("reliability"),
    )


@query(f"""
    WITH {PROFILES_SQL} SELECT doc_id, founder_likelihood, collaborative_edge, structural_demand, mutual_value, technical_credibility, market_pain, market_timing, investor_fit, outreach_urgency, red_flag_risk, data_quality,
        round(confidence, 9) AS confidence, total, recommendation, founder_label FROM u
""")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven dimensions of each profile, its confidence, total, tier and label."""
    return scored(spark, sf_dir).select("doc_id", *P.DIMENSIONS, F.round("confidence", 9).alias("confidence"), "total", "recommendation", "founder_label")


@query(f"""
    WITH {PROFILES_SQL} SELECT doc_id, CAST(floor(founder_likelihood / 10.0 + 0.5) AS BIGINT) AS founder_quality, CAST(floor((collaborative_edge + structural_demand) / 20.0 + 0.5) AS BIGINT) AS founder_market_fit,
        CAST(floor(technical_credibility / 10.0 + 0.5) AS BIGINT) AS technical, CAST(floor((market_pain + investor_fit) / 20.0 + 0.5) AS BIGINT) AS commercial, CAST(floor((market_pain + market_timing) / 20.0 + 0.5) AS BIGINT) AS market_size,
        CAST(floor(market_timing / 10.0 + 0.5) AS BIGINT) AS timing, CAST(floor(least(100.0, x_builder * 70 + has_site * 30) / 10.0 + 0.5) AS BIGINT) AS traction, CAST(floor(investor_fit / 10.0 + 0.5) AS BIGINT) AS fundability,
        CAST(floor(least(100.0, x_cross * 35 + x_investor * 35 + x_links * 30) / 10.0 + 0.5) AS BIGINT) AS network, CAST(floor(red_flag_risk / 10.0 + 0.5) AS BIGINT) AS red_flags, CAST(floor(data_quality / 10.0 + 0.5) AS BIGINT) AS data FROM u
""")
def profile_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in P.scorecard().items()])


@query(f"""
    WITH {PROFILES_SQL} SELECT doc_id, array_to_string(signals, ';') AS signals, array_to_string(list_filter([CASE WHEN len(ai) = 0 THEN 'No clear AI-native signal in visible evidence.' END, CASE WHEN len(b2b) = 0 THEN 'B2B buyer or workflow is not explicit yet.' END,
        CASE WHEN has_site = 0 THEN 'No non-LinkedIn public product proof found in visible links.' END, CASE WHEN founder_likelihood < 40 THEN 'Founder status is not well supported by the captured text.' END,
        CASE WHEN red_flag_risk > 45 THEN 'Profile has vague or early-stage wording that needs human diligence.' END, CASE WHEN stealth > 0 THEN 'Stealth mention without a public site or company name.' END], lambda x: x IS NOT NULL), ' ') AS risks,
        array_to_string(list_filter([CASE WHEN has_site = 0 THEN 'company website or product demo' END, CASE WHEN has_github = 0 THEN 'technical proof from GitHub or product docs' END, CASE WHEN has_hn = 0 THEN 'Hacker News or developer-community signal' END,
        CASE WHEN len(investor) = 0 THEN 'direct investor or fundraising evidence' END, CASE WHEN len(pain) = 0 THEN 'customer pain language' END], lambda x: x IS NOT NULL), ', ') AS missing,
        name || ' has ' || CASE WHEN founder_likelihood >= 60 THEN 'strong founder signal' WHEN founder_likelihood >= 40 THEN 'possible founder signal' ELSE 'weak founder evidence' END || ' around ' || CASE WHEN company = '' THEN 'the company' ELSE company END || '. '
        || CASE WHEN len(ai) > 0 THEN 'AI signal: ' || array_to_string(ai[1:3], ', ') ELSE 'AI signal unknown' END || '. ' || CASE WHEN len(b2b) > 0 THEN 'B2B surface: ' || array_to_string(b2b[1:3], ', ') ELSE 'buyer surface unknown' END || '. '
        || CASE WHEN len(crossb) > 0 THEN 'Fit: ' || array_to_string(crossb[1:3], ', ') ELSE 'cross-border fit unproven' END || '.' AS summary FROM u
""")
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with their words and evidence, risks, missing evidence and the summary of each profile."""
    lines = F.array_join(F.transform("signals", lambda s: F.concat_ws("|", s["label"], s["words"], s["evidence"])), ";")
    return scored(spark, sf_dir).select("doc_id", lines.alias("signals"), F.array_join(P.risks(), " ").alias("risks"), F.array_join(P.missing_evidence(), ", ").alias("missing"), P.summary().alias("summary"))


@query(f"""
    WITH {PROFILES_SQL}, {STAGE_SQL}
    SELECT doc_id, stage, CASE stage WHEN 'series_a_plus' THEN 0.75 WHEN 'seed' THEN 0.72 WHEN 'pre_seed' THEN 0.7 WHEN 'mvp_beta' THEN 0.68 WHEN 'pre_product' THEN 0.58 WHEN 'idea_stealth' THEN 0.5 ELSE 0.35 END::DOUBLE AS confidence,
        CASE stage WHEN 'series_a_plus' THEN 1 WHEN 'mvp_beta' THEN 1 WHEN 'unknown' THEN 4 ELSE 2 END::BIGINT AS n_missing FROM k
""")
def profile_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.with_features(profiles(spark, sf_dir)).select("doc_id", P.stage().alias("s"))
    return s.select("doc_id", "s.stage", "s.confidence", F.size("s.missing").cast("long").alias("n_missing"))


@query(f"""
    WITH {PROFILES_SQL}, e AS (SELECT doc_id, unnest([{{'d': 'market_timing', 'i': 'has_hn', 'v': has_hn, 'w': 0.4}}, {{'d': 'market_timing', 'i': 'yc', 'v': yc, 'w': 0.3}}, {{'d': 'market_timing', 'i': 'ai', 'v': x_ai, 'w': 0.4}}, {{'d': 'market_timing', 'i': 'launch', 'v': launch, 'w': 0.3}},
        {{'d': 'red_flag_risk', 'i': 'risk', 'v': x_risk, 'w': 0.5}}, {{'d': 'red_flag_risk', 'i': 'low_founder', 'v': CAST(founder_likelihood < 35 AS DOUBLE), 'w': 0.5}}, {{'d': 'red_flag_risk', 'i': 'no_company', 'v': 1 - has_company, 'w': 0.4}}, {{'d': 'red_flag_risk', 'i': 'no_site', 'v': 1 - has_site, 'w': 0.3}}]) AS r FROM u)
    SELECT doc_id, r.d AS dimension, r.i AS input, round(r.v, 2) AS value, CAST(r.w AS DOUBLE) AS weight, round(r.v * r.w::DOUBLE, 2) AS contribution FROM e
""")
def profile_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes into two of the dimensions."""
    s = scored(spark, sf_dir)
    inputs = s.select("doc_id", F.explode_outer(F.create_map(*[c for d in ("market_timing", "red_flag_risk") for c in (F.lit(d), P.explanation(d))])).alias("dimension", "inputs"))
    return inputs.select("doc_id", "dimension", F.explode_outer("inputs").alias("r")).select("doc_id", "dimension", "r.*")


@query(f"""
    WITH {PROFILES_SQL}, x AS (SELECT doc_id, total, recommendation, founder_label, unnest(signals) AS signal FROM u), y AS (SELECT *, string_split(signal, '|') AS q FROM x)
    SELECT 'deal' || doc_id AS deal_id, substr(sha256('deal' || doc_id || '|' || q[1]), 1, 32) AS claim_id, q[1] AS claim_type, q[1] || ': ' || q[2] AS claim_text, CASE WHEN q[1] = 'Founder/operator language' THEN 'strong_inference' ELSE 'weak_signal' END AS status,
        CASE WHEN q[3] = '' THEN 0 ELSE 1 END::BIGINT AS n_evidence, CASE WHEN total >= 72 THEN 'partner-review' WHEN recommendation = 'monitor' THEN 'watch' ELSE 'new' END AS deal_status FROM y
""")
def deal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deal of each profile: one claim per signal, sure ones as strong inference; ids come from their names."""
    s = scored(spark, sf_dir)
    deal = F.concat(F.lit("deal"), F.col("doc_id"))
    status = F.when(F.col("total") >= 72, "partner-review").when(F.col("recommendation") == "monitor", "watch").otherwise("new")
    # The outer form: the other one asks below all projections whether there are signals, which repeats every lexicon there.
    rows = s.select(deal.alias("deal_id"), status.alias("deal_status"), F.explode_outer("signals").alias("s")).where("s IS NOT NULL")
    return rows.select(
        "deal_id",
        F.substring(F.sha2(F.concat_ws("|", "deal_id", "s.label"), 256), 1, 32).alias("claim_id"),
        F.col("s.label").alias("claim_type"),
        F.concat_ws(": ", "s.label", "s.words").alias("claim_text"),
        F.when(F.col("s.confidence") >= 0.75, "strong_inference").otherwise("weak_signal").alias("status"),
        F.when(F.col("s.evidence") != "", 1).otherwise(0).cast("long").alias("n_evidence"),
        "deal_status",
    )


@query(f"""
    WITH {PROFILES_SQL}, e AS (SELECT doc_id, unnest([{{'f': 'name', 't': name, 'q': name}}, {{'f': 'headline', 't': headline, 'q': headline}}, {{'f': 'about', 't': about, 'q': about}}, {{'f': 'company', 't': company, 'q': company}},
        {{'f': 'experience', 't': array_to_string(experience, chr(10)), 'q': coalesce(experience[1], '')}}, {{'f': 'posts', 't': array_to_string(posts, chr(10)), 'q': coalesce(posts[1], '')}}, {{'f': 'links', 't': array_to_string(links, chr(10)), 'q': coalesce(links[1], '')}}]) AS r FROM p)
    SELECT 'deal' || doc_id AS deal_id, r.f AS field, sha256(substr(r.t, 1, 4000)) AS text_sha256, sha256(substr(CASE WHEN r.q <> '' THEN r.q ELSE r.t END, 1, 500)) AS quote_sha256 FROM e WHERE trim(r.t) <> ''
""")
def deal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of evidence per filled field of a profile: its text and a quote, cut."""
    f = P.with_features(profiles(spark, sf_dir))
    lists = ("experience", "posts", "links")
    parts = [F.struct(F.lit(c).alias("field"), (F.array_join(c, "\n") if c in lists else F.col(c)).alias("text"), (F.coalesce(F.get(c, F.lit(0)), F.lit("")) if c in lists else F.col(c)).alias("quote")) for c in P.EVIDENCE_FIELDS]
    rows = f.select(F.concat(F.lit("deal"), F.col("doc_id")).alias("deal_id"), F.explode_outer(F.array(*parts)).alias("r")).select("deal_id", "r.*").where("trim(text) <> ''")
    quote = F.when(F.col("quote") != "", F.col("quote")).otherwise(F.col("text"))
    return rows.select("deal_id", "field", F.sha2(F.substring("text", 1, 4000), 256).alias("text_sha256"), F.sha2(F.substring(quote, 1, 500), 256).alias("quote_sha256"))


@query(f"""
    WITH {PROFILES_SQL}, b AS (SELECT doc_id, founder_likelihood, confidence, (doc_id * 7 % 101)::DOUBLE AS other, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id * 3 % 130 / 100.0::DOUBLE END AS sure FROM u)
    SELECT doc_id, CAST(floor((1 - least(1.0, coalesce(sure, 0.0))) * founder_likelihood + least(1.0, coalesce(sure, 0.0)) * other + 0.5) AS BIGINT) AS blended, round((1 - least(1.0, coalesce(sure, 0.0))) * confidence + least(1.0, coalesce(sure, 0.0)), 9) AS confidence FROM b
""")
def profile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores moved towards a second opinion as far as that one is sure."""
    other, sure = (F.col("doc_id") * 7 % 101).cast("double"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") * 3 % 130 / 100)
    s = scored(spark, sf_dir).select("doc_id", "founder_likelihood", "confidence", other.alias("other"), sure.alias("sure"))
    share = P.held(F.coalesce("sure", F.lit(0.0)), 0.0, 1.0)
    return s.select("doc_id", P.blend(F.col("founder_likelihood"), F.col("other"), F.col("sure")).alias("blended"), F.round((1 - share) * F.col("confidence") + share, 9).alias("confidence"))


@query(f"""
    WITH {PROFILES_SQL} SELECT recommendation, count(*) AS deals, count(*) FILTER (WHERE outreach_urgency >= 70) AS urgent, CAST(floor(avg(total) + 0.5) AS BIGINT) AS mean_total, CAST(sum(n_ev) AS BIGINT) AS evidence, round(avg(confidence), 2) AS mean_confidence,
        round(avg(reliability), 6) AS mean_reliability FROM u GROUP BY recommendation
""")
def deal_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tier: deals, urgent ones, mean total, pieces of evidence, mean confidence and reliability."""
    return scored(spark, sf_dir).groupBy("recommendation").agg(
        F.count(F.lit(1)).alias("deals"),
        F.count_if(F.col("outreach_urgency") >= 70).alias("urgent"),
        P.half_up(F.avg("total")).alias("mean_total"),
        F.sum(F.col("n_evidence").cast("long")).alias("evidence"),
        F.round(F.avg("confidence"), 2).alias("mean_confidence"),
        F.round(F.avg("f_reliability"), 6).alias("mean_reliability"),
    )
