"""Scores of profiles: features, logistic dimensions, confidence, tiers and lists of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as T

#: Words that count for each feature, in their order.
LEXICONS = {
    "ai": ("ai", "artificial intelligence", "llm", "agent", "agents", "machine learning", "ml", "automation", "copilot", "workflow", "reasoning", "model", "data"),
    "b2b": ("b2b", "enterprise", "workflow", "platform", "saas", "developer", "infrastructure", "compliance", "finance", "ops", "supply chain", "sales", "security", "hr"),
    "founder": ("founder", "co-founder", "cofounder", "founding", "ceo", "cto", "stealth founder", "startup founder"),
    "builder": ("building", "built", "launched", "demo", "beta", "waitlist", "github", "api", "open source", "product", "release", "ship", "shipping"),
    "pain": ("manual", "pain", "broken", "slow", "expensive", "inefficient", "fragmented", "compliance", "legacy", "spreadsheet", "workaround", "labor shortage"),
    "investor": ("fundraising", "pre-seed", "preseed", "seed", "angel", "investor", "vc", "accelerator", "yc", "techstars", "raise"),
    "cross_border": ("turkey", "turkish", "istanbul", "ankara", "immigrant", "diaspora", "us market", "u.s.", "united states", "cross-border", "global", "san francisco", "new york", "amsterdam", "europe"),
    "risk": ("stealth", "advisor", "consultant", "fractional", "student", "aspiring", "exploring", "idea", "coming soon"),
}
#: How many hits of each list count in full.
HITS_IN_FULL = {"founder": 3, "builder": 4, "pain": 3, "investor": 3, "cross_border": 3, "risk": 3, "ai": 3, "b2b": 3}
#: Words of the yes-or-no features.
MENTIONS = {
    "customer": ("customer", "customers", "design partner", "design partners", "paying user"),
    "enterprise": ("enterprise", "fortune", "gtm", "rfp", "procurement"),
    "launch": ("launch", "launched", "ship", "shipped", "shipping", "release", "public beta"),
    "hiring": ("hiring", "we are hiring", "open roles", "careers"),
    "yc": ("yc", "y combinator", "ycombinator"),
}
TECHNICAL_ROLE = r"(?i)\b(engineer|engineering|cto|developer|technical|architect|software)\b"
#: What a source's reliability is worth.
RELIABILITY = {"high": 1.0, "medium_high": 0.75, "medium": 0.5, "medium_low": 0.3, "low": 0.15}
#: The bias and the weights of each dimension's logistic model.
DIMENSIONS = {
    "founder_likelihood": (-0.6, {"has_company": 0.5, "has_site": 0.4, "has_github": 0.4, "has_hn": 0.4, "founder": 0.4, "builder": 0.3, "student": -0.7, "stealth": -0.5}),
    "collaborative_edge": (-0.4, {"has_company": 0.5, "has_site": 0.4, "founder": 0.5, "cross_border": 0.3, "posts": 0.2}),
    "structural_demand": (-0.5, {"ai": 0.6, "b2b": 0.5, "pain": 0.4, "has_company": 0.3}),
    "mutual_value": (-0.4, {"about_richness": 0.4, "experience": 0.25, "education": 0.2, "has_site": 0.5, "evidence": 0.3}),
    "technical_credibility": (-0.4, {"builder": 0.4, "has_github": 0.5, "skills": 0.3, "technical_role": 0.4}),
    "market_pain": (-0.5, {"pain": 0.5, "b2b": 0.4, "customer": 0.3, "enterprise": 0.3}),
    "market_timing": (-0.3, {"has_hn": 0.4, "yc": 0.3, "ai": 0.4, "launch": 0.3}),
    "investor_fit": (-0.3, {"investor": 0.4, "cross_border": 0.3, "b2b": 0.3, "ai": 0.3}),
    "outreach_urgency": (-0.3, {"launch": 0.4, "hiring": 0.3, "investor": 0.4, "posts": 0.3}),
    "red_flag_risk": (-1.0, {"risk": 0.5, "low_founder": 0.5, "no_company": 0.4, "no_site": 0.3}),
    "data_quality": (-0.4, {"evidence": 0.35, "links": 0.2, "about_present": 0.3, "experience_present": 0.3, "reliability": 0.4}),
}
#: Shares of the total, and tiers by least total, least confidence and most risk.
TOTAL_WEIGHTS = {"collaborative_edge": 0.18, "structural_demand": 0.18, "mutual_value": 0.12, "technical_credibility": 0.14, "market_pain": 0.13, "investor_fit": 0.11, "outreach_urgency": 0.14}
TIERS = (("immediate_outreach", 80, 0.65, 40), ("take_meeting", 72, 0.55, 55), ("partner_review", 64, 0.50, 70), ("monitor", 42, 0.30, 85))
#: Words of each stage, the latest stage first, with a confidence and what is missing.
STAGES = (
    ("series_a_plus", ("series a", "series b", "series c", "growth round"), 0.75, ("recent funding announcement",)),
    ("seed", (" seed ", "seed round", "seed-stage"), 0.72, ("round size", "lead investor")),
    ("pre_seed", ("pre-seed", "preseed", "angel round"), 0.7, ("product traction", "customer proof")),
    ("mvp_beta", ("beta", "pilot", "demo", "launched", "public product"), 0.68, ("active customer proof",)),
    ("pre_product", ("waitlist", "coming soon", "landing page"), 0.58, ("demo", "customer usage")),
    ("idea_stealth", ("stealth", "building", "exploring"), 0.5, ("website", "product proof")),
)
NO_STAGE = ("unknown", 0.35, ("website", "product proof", "funding status", "customer proof"))
#: Fields whose text is evidence, and what each kind of signal says, weighs and rests on.
EVIDENCE_FIELDS = ("name", "headline", "about", "company", "experience", "posts", "links")
SIGNALS = (
    ("founder", "Collaborative Edge", "Founder/operator language", 0.5, 0.78, "headline"),
    ("builder", "Technical Credibility", "Builder proof language", 0.4, 0.7, "about"),
    ("cross_border", "Collaborative Edge", "Cross-border fit", 0.3, 0.64, "about"),
    ("ai", "Structural Demand", "AI-native vocabulary", 0.6, 0.72, "about"),
    ("pain", "Market Pain", "B2B pain surface", 0.5, 0.68, "about"),
    ("has_site", "Mutual Value", "Public proof link", 0.5, 0.7, "links"),
    ("investor", "Investor Fit", "Fundraising or investor context", 0.4, 0.6, "posts"),
    ("risk", "Risk", "Risk language", 0.5, 0.55, "about"),
)
FOUNDER_LABELS = ((80, "confirmed_founder"), (60, "very_likely_founder"), (40, "possible_founder"), (20, "weak_signal"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def held(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def source_reliability(url: Column, kind: Column) -> Column:
    """How far a source can be trusted, by its kind and host; the first rule that holds counts.

    Any host that ends in .com is high, but for a few; this is as the values were fitted.
    """
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return (
        F.when(kind.contains("approved_api") | kind.contains("official_api"), "high")
        .when(host.rlike(r"(^|\.)company|\.com$") & ~host.rlike(r"(linkedin|twitter|x\.com|reddit)"), "high")
        .when(host.rlike(r"github\.com|news\.ycombinator\.com|producthunt\.com"), "medium_high")
        .when(host.rlike(r"linkedin\.com"), "medium_high")
        .when(host.rlike(r"techcrunch|sifted|crunchbase|ycombinator"), "medium")
        .otherwise("medium_low")
    )


def worth(reliability: Column) -> Column:
    out = F.lit(RELIABILITY["medium_low"])
    for name, value in RELIABILITY.items():
        out = F.when(reliability == name, value).otherwise(out)
    return out


def with_corpus(profiles: DataFrame) -> DataFrame:
    """Adds the lower-cased text of all filled fields, joined by one space."""
    scalars = [F.when(F.col(c) != "", F.col(c)) for c in ("name", "headline", "location", "about", "company", "website", "raw")]
    lists = [F.filter(c, lambda x: x != "") for c in ("current_roles", "past_roles", "experience", "education", "skills", "posts", "links")]
    return profiles.withColumn("corpus", F.lower(F.array_join(F.concat(F.array_compact(F.array(*scalars)), *lists), " ")))


def with_features(profiles: DataFrame) -> DataFrame:
    """Adds the corpus, hit lists (``hits_*``) and all features (``f_*``, from 0 to 1).

    ``profiles`` has name, headline, location, about, company, website, company_url, raw,
    source_url, source_type and mode as texts, and current_roles, past_roles, experience,
    education, skills, posts, links, github_names and hn_names as lists. Nulls are empty.
    """
    texts = ("name", "headline", "location", "about", "company", "website", "company_url", "raw", "source_url", "source_type", "mode")
    lists = ("current_roles", "past_roles", "experience", "education", "skills", "posts", "links", "github_names", "hn_names")
    filled = profiles.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    corpus = with_corpus(filled)
    found = corpus.withColumns({f"hits_{name}": T.term_hits(F.col("corpus"), terms, lowered=True) for name, terms in LEXICONS.items()})
    low = F.col("corpus")

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    def share(count: Column, full: int) -> Column:
        return F.least(count / full, F.lit(1.0))

    addresses = F.concat(F.array("website", "company_url"), "links")
    evidence = sum((flag(F.trim(F.array_join(c, "\n") if c in lists else F.col(c)) != "") for c in EVIDENCE_FIELDS), F.lit(0.0))
    base = found.withColumns({
        "n_evidence": evidence,
        "f_has_company": flag((F.col("company") != "") | (F.col("website") != "") | (F.col("company_url") != "")),
        "f_has_site": flag(F.exists(addresses, lambda a: ~a.contains("linkedin.com") & a.rlike("^https?://"))),
        "f_has_github": flag((F.size("github_names") > 0) | low.contains("github.com")),
        "f_has_hn": flag((F.size("hn_names") > 0) | low.contains("news.ycombinator.com") | low.contains("show hn")),
        "f_technical_role": flag(F.exists(F.concat("experience", "current_roles", "past_roles"), lambda r: r.rlike(TECHNICAL_ROLE))),
        "f_student": flag((F.size("hits_founder") == 0) & low.contains("student")),
    })
    own = F.when((F.col("mode") == "manual_paste") & (F.col("n_evidence") > 0), RELIABILITY["medium_high"]).when(F.col("n_evidence") > 0, RELIABILITY["medium"]).otherwise(RELIABILITY["medium_low"])
    named = F.when(F.col("source_url") != "", worth(source_reliability(F.col("source_url"), F.col("source_type"))))
    more = {
        "f_stealth": flag(low.contains("stealth") & (F.col("f_has_site") == 0) & (F.col("f_has_company") == 0)),
        "f_about_present": flag(F.col("about") != ""),
        "f_experience_present": flag(F.size("experience") > 0),
        "f_posts": share(F.size("posts"), 5),
        "f_experience": share(F.size("experience"), 3),
        "f_education": share(F.size("education"), 2),
        "f_skills": share(F.size("skills"), 3),
        "f_about_richness": share(F.length("about"), 240),
        "f_evidence": share(F.col("n_evidence"), 6),
        "f_links": share(F.size("links"), 6),
        "f_reliability": F.greatest(own, named),
        "f_no_company": 1 - F.col("f_has_company"),
        "f_no_site": 1 - F.col("f_has_site"),
    }
    more |= {f"f_{name}": flag(T.any_term(low, terms, lowered=True)) for name, terms in MENTIONS.items()}
    more |= {f"f_{name}": share(F.size(f"hits_{name}"), full) for name, full in HITS_IN_FULL.items()}
    return base.withColumns(more)


def dimension(name: str) -> Column:
    """A dimension from the feature columns: 100 times the logistic of their weighted sum, halves up."""
    bias, weights = DIMENSIONS[name]
    linear = sum((F.col(f"f_{f}") * w for f, w in weights.items()), F.lit(0.0)) + bias
    return half_up(100 / (1 + F.exp(-linear)))


def with_scores(featured: DataFrame) -> DataFrame:
    """Adds all dimensions, ``coverage``, ``confidence``, ``total``, ``recommendation`` and ``founder_label``.

    The founder dimension goes first, as a low one raises the risk.
    """
    first = featured.withColumn("founder_likelihood", dimension("founder_likelihood"))
    first = first.withColumn("f_low_founder", F.when(F.col("founder_likelihood") < 35, 1.0).otherwise(0.0))
    scored = first.withColumns({d: dimension(d) for d in DIMENSIONS if d != "founder_likelihood"}).withColumn("signals", signals())
    backed = F.size(F.filter("signals", lambda s: s["evidence"] != ""))
    rated = scored.withColumn("coverage", F.coalesce(F.try_divide(backed, F.size("signals")), F.lit(0.0)))
    gate = 0.85 + 0.25 * (F.col("data_quality") / 100)
    confidence = F.pow(F.col("data_quality") / 100, F.lit(0.9)) * (0.5 + 0.5 * F.col("coverage")) * (0.5 + 0.5 * F.col("f_reliability")) * F.col("f_evidence")
    weighted = sum((F.col(d) * w for d, w in TOTAL_WEIGHTS.items()), F.lit(0.0))
    summed = rated.withColumns({"confidence": held(confidence, 0.0, 1.0), "total": held(half_up(weighted * gate))})
    tier, label = F.lit("pass"), F.lit("not_enough_evidence")
    for name, least, sure, risk in reversed(TIERS):
        tier = F.when((F.col("total") >= least) & (F.col("confidence") >= sure) & (F.col("red_flag_risk") <= risk), name).otherwise(tier)
    for least, name in reversed(FOUNDER_LABELS):
        label = F.when(F.col("founder_likelihood") >= least, name).otherwise(label)
    return summed.withColumns({"recommendation": tier, "founder_label": label})


def signals() -> Column:
    """Array of (principle, label, words, weight, confidence, evidence) of what was found, the weightiest first."""

    def present(c: str) -> Column:
        filled = F.trim(F.array_join(c, "\n") if c in ("posts", "links") else F.col(c)) != ""
        return F.when(filled, c).otherwise("")

    words = {k: F.array_join(F.slice(f"hits_{k}", 1, n), ", ") for k, n in (("founder", 5), ("builder", 5), ("cross_border", 5), ("ai", 5), ("investor", 4))}
    words["pain"] = F.array_join(F.slice(F.concat("hits_b2b", "hits_pain"), 1, 6), ", ")
    words["has_site"] = F.lit("company website or non-LinkedIn public link")
    words["risk"] = F.array_join(F.slice(F.concat("hits_risk", F.when(F.col("f_stealth") > 0, F.array(F.lit("stealth flag"))).otherwise(F.array().cast("array<string>"))), 1, 5), ", ")
    holds = {k: F.col(f"f_{k}") > 0 for k, *_ in SIGNALS} | {"pain": (F.col("f_b2b") > 0) | (F.col("f_pain") > 0), "risk": (F.col("f_risk") > 0) | (F.col("f_stealth") > 0)}
    rows = []
    for at, (key, principle, label, weight, sure, field) in enumerate(SIGNALS):
        row = F.struct(F.lit(-weight).alias("order"), F.lit(at).alias("at"), F.lit(principle).alias("principle"), F.lit(label).alias("label"), words[key].alias("words"), F.lit(weight).alias("weight"), F.lit(sure).alias("confidence"), present(field).alias("evidence"))
        rows.append(F.when(holds[key], row))
    return F.array_sort(F.array_compact(F.array(*rows)))


def scorecard() -> dict[str, Column]:
    """Eleven marks from 0 to 10 out of the dimensions and features."""

    def mark(x: Column) -> Column:
        return half_up(held(x) / 10)

    c = F.col
    return {
        "founder_quality": mark(c("founder_likelihood")),
        "founder_market_fit": mark((c("collaborative_edge") + c("structural_demand")) / 2),
        "technical": mark(c("technical_credibility")),
        "commercial": mark((c("market_pain") + c("investor_fit")) / 2),
        "market_size": mark((c("market_pain") + c("market_timing")) / 2),
        "timing": mark(c("market_timing")),
        "traction": mark(c("f_builder") * 70 + c("f_has_site") * 30),
        "fundability": mark(c("investor_fit")),
        "network": mark(c("f_cross_border") * 35 + c("f_investor") * 35 + c("f_links") * 30),
        "red_flags": mark(c("red_flag_risk")),
        "data": mark(c("data_quality")),
    }


def findings(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(note)) for c, note in checks]))


def risks() -> Column:
    c = F.col
    return findings([
        (c("f_ai") == 0, "No clear AI-native signal in visible evidence."),
        (c("f_b2b") == 0, "B2B buyer or workflow is not explicit yet."),
        (c("f_has_site") == 0, "No non-LinkedIn public product proof found in visible links."),
        (c("founder_likelihood") < 40, "Founder status is not well supported by the captured text."),
        (c("red_flag_risk") > 45, "Profile has vague or early-stage wording that needs human diligence."),
        (c("f_stealth") > 0, "Stealth mention without a public site or company name."),
    ])


def missing_evidence() -> Column:
    c = F.col
    return findings([
        (c("f_has_site") == 0, "company website or product demo"),
        (c("f_has_github") == 0, "technical proof from GitHub or product docs"),
        (c("f_has_hn") == 0, "Hacker News or developer-community signal"),
        (c("f_investor") == 0, "direct investor or fundraising evidence"),
        (c("f_pain") == 0, "customer pain language"),
    ])


def stage() -> Column:
    """struct(stage, confidence, missing) by the words of headline, about, raw text, posts and experience."""
    low = F.lower(F.concat_ws(" ", "headline", "about", "raw", F.array_join("posts", " "), F.array_join("experience", " ")))

    def found(name: str, sure: float, missing: tuple[str, ...]) -> Column:
        return F.struct(F.lit(name).alias("stage"), F.lit(sure).alias("confidence"), F.array(*map(F.lit, missing)).alias("missing"))

    out = found(*NO_STAGE)
    for name, terms, sure, missing in reversed(STAGES):
        out = F.when(T.any_term(low, terms, lowered=True), found(name, sure, missing)).otherwise(out)
    return out


def summary() -> Column:
    """One sentence about a scored profile."""

    def part(name: str, lead: str, without: str) -> Column:
        return F.when(F.size(f"hits_{name}") > 0, F.concat(F.lit(lead), F.array_join(F.slice(f"hits_{name}", 1, 3), ", "))).otherwise(without)

    founder = F.when(F.col("founder_likelihood") >= 60, "strong founder signal").when(F.col("founder_likelihood") >= 40, "possible founder signal").otherwise("weak founder evidence")
    who = F.when(F.col("name") != "", F.col("name")).otherwise("This profile")
    what = F.when(F.col("company") != "", F.col("company")).otherwise("the company")
    ai, buyer, bridge = part("ai", "AI signal: ", "AI signal unknown"), part("b2b", "B2B surface: ", "buyer surface unknown"), part("cross_border", "Fit: ", "cross-border fit unproven")
    return F.concat(who, F.lit(" has "), founder, F.lit(" around "), what, F.lit(". "), ai, F.lit(". "), buyer, F.lit(". "), bridge, F.lit("."))


def explanation(name: str) -> Column:
    """Array of (input, value, weight, contribution) of one dimension, values to two digits."""
    _, weights = DIMENSIONS[name]
    return F.array(*[F.struct(F.lit(f).alias("input"), F.round(F.col(f"f_{f}"), 2).alias("value"), F.lit(float(w)).alias("weight"), F.round(F.col(f"f_{f}") * w, 2).alias("contribution")) for f, w in weights.items()])


def blend(own: Column, other: Column, sure: Column) -> Column:
    """A score moved towards another one as far as that one is sure (0 to 1), halves up."""
    share = held(F.coalesce(sure, F.lit(0.0)), 0.0, 1.0)
    return half_up((1 - share) * own + share * other)
