"""Signals of forum stories, repositories and launches, and tests of addresses and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.functions import text as T

#: Phrases with their weight and label; of a label the first phrase that holds counts.
PAIN = (
    ("would pay", 0.9, "willingness to pay"), ("pay for", 0.7, "willingness to pay"), ("we built this internally", 0.85, "internal workaround"), ("we built our own", 0.8, "internal workaround"),
    ("is broken", 0.75, "high-friction language"), ("frustrating", 0.65, "high-friction language"), ("pain point", 0.7, "pain language"), ("workaround", 0.65, "workaround language"),
    ("spreadsheet hell", 0.85, "workaround language"), ("zapier glue", 0.6, "workaround language"),
)
PRODUCT = (
    ("live demo", 0.7, "demo available"), ("try the demo", 0.8, "demo available"), ("open source", 0.7, "open source positioning"), ("self-hosted", 0.65, "self-host option"),
    ("api docs", 0.7, "API discussed"), ("rest api", 0.55, "API discussed"), ("sdk", 0.55, "SDK available"), ("waitlist", 0.6, "waitlist gated"),
)
#: What a launch post shows, and paths of tests, documents and automatic builds.
SHOWN = (("demo", "demo available"), ("github", "source or repo linked"), ("waitlist", "waitlist only"), ("api", "API surface"), ("open source", "open-source positioning"))
TEST_PATH = r"(?i)(^|/)(test|tests|spec|specs|__tests__|vitest|pytest|jest)([./]|$)"
DOCS_PATH = r"(?i)(^|/)(docs?|examples?|guides?)([./]|$)"
BUILD_PATH = r"\.github/workflows|\.gitlab-ci|\.circleci|\.travis|\.azure-pipelines"
#: Stages from early to late, and weights by stage.
STAGES = ("idea", "prototype", "pre-seed", "seed", "series-a", "growth")
PRESETS = {
    "pre-seed": {"founder_quality": 0.40, "thesis_fit": 0.30, "is_building": 0.10, "timing": 0.15, "reachable": 0.05, "too_late": 0.40},
    "seed": {"founder_quality": 0.30, "thesis_fit": 0.30, "is_building": 0.20, "timing": 0.15, "reachable": 0.05, "too_late": 0.35},
    "later": {"is_building": 0.35, "thesis_fit": 0.30, "founder_quality": 0.15, "timing": 0.15, "reachable": 0.05, "too_late": 0.20},
}


def lexicon_labels(text: Column, lexicon: Sequence[tuple[str, float, str]]) -> Column:
    """Array of (label, weight) of the phrases that a text holds, each label once."""
    low = F.lower(text)
    rows, seen = [], {}
    for term, weight, label in lexicon:
        hit = low.contains(term)
        rows.append(F.when(hit & ~seen.get(label, F.lit(False)), F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))))
        seen[label] = seen.get(label, F.lit(False)) | hit
    return F.array_compact(F.array(*rows))


def shows_product(title: Column) -> Column:
    return F.trim(title).rlike("(?i)^show hn:?")


def shown(title: Column, url: Column, text: Column) -> Column:
    """What title, address and text of a launch post say it has."""
    corpus = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(*[F.when(corpus.contains(term), F.lit(label)) for term, label in SHOWN]))


def story_score(points: Column, age_days: Column) -> Column:
    return F.floor(F.coalesce(points, F.lit(0)) * S.decay(age_days) + 0.5).cast("long")


def any_path(paths: Column, pattern: str) -> Column:
    return F.exists(paths, lambda p: p.rlike(pattern))


def repository_quality(readme: Column, paths: Column, age_days: Column) -> Column:
    """The description's points by the age of the last commit, and six for automatic builds."""
    builds = F.when(any_path(paths, BUILD_PATH), 6).otherwise(0)
    return F.floor(T.readme_quality(readme) * S.commit_recency(age_days) + builds + 0.5).cast("long")


def network_page(url: Column) -> Column:
    """Whether an address is on the network of profiles; false for what is no address."""
    return F.coalesce(T.host(url).rlike(r"(^|\.)linkedin\.com$"), F.lit(False))


def network_product(url: Column) -> Column:
    """Whether an address is a paid product of that network, which is never captured."""
    return F.coalesce(url.rlike(r"(?i)linkedin\.com/(sales|recruiter|talent|learning)\b"), F.lit(False))


def mailbox_page(url: Column) -> Column:
    """Whether an address is somebody's mailbox, private by default."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.rlike(r"^mail\.google\.com$|^outlook\.(live|office|office365)\.com$"), F.lit(False))


def profile_like(text: Column) -> Column:
    return text.rlike(r"(?i)(^|[^A-Za-z0-9_])(founder|co-founder|ceo|cto|building|startup|experience|education|about)([^A-Za-z0-9_]|$)")


def pasted_profile(text: Column) -> Column:
    """Whether a pasted text comes from a profile page: any of five marks, most in its head."""
    head = F.substring(text, 1, 8000)
    marks = head.rlike(r"(?i)·\s*(?:1st|2nd|3rd)") | head.rlike(r"(?i)mutual connections?") | head.rlike(r"(?i)contact info")
    words = head.rlike(r"(?i)connections?") & head.rlike(r"(?i)\bmessage\b") & head.rlike(r"(?i)\bhighlights?\b")
    return text.rlike(r"(?i)linkedin\.com") | marks | words


def stage_of(prose: Column) -> Column:
    """The earliest stage that a text names, with a hyphen or a space; seed if none."""
    low, out = F.lower(prose), F.lit("seed")
    for name in reversed(STAGES):
        out = F.when(low.contains(name) | low.contains(name.replace("-", " ")), name).otherwise(out)
    return out


def preset_of(stage: Column) -> Column:
    return F.when(stage.isin("idea", "prototype", "pre-seed"), "pre-seed").when(stage.isin("series-a", "growth"), "later").otherwise("seed")


def research_queries(name: Column, company: Column, headline: Column, about: Column) -> Column:
    """Search phrases about a person and a company, those that lack their subject left out."""
    who, what = F.when(name != "", name), F.when(company != "", company)
    long_words = F.filter(F.split(F.concat_ws(" ", F.coalesce(company, F.lit("")), F.coalesce(headline, F.lit("")), F.coalesce(about, F.lit(""))), r"\W+"), lambda w: F.length(w) > 4)
    product = F.when(F.size(long_words) > 0, F.array_join(F.slice(long_words, 1, 6), " "))

    def quoted(x: Column, lead: str = "", tail: str = "") -> Column:
        return F.concat(F.lit(f'{lead}"'), x, F.lit(f'"{tail}'))

    return F.array_compact(F.array(
        quoted(what, tail=" startup founder product"),
        quoted(what, tail=" funding pre-seed seed investor"),
        F.coalesce(F.concat(quoted(who), F.lit(" "), quoted(what)), quoted(who, tail=" founder startup")),
        quoted(what, tail=" co-founder team"),
        quoted(what, tail=" alternatives competitors"),
        quoted(product, tail=" market size startup"),
        quoted(what, tail=" demo waitlist product launch"),
        quoted(what, tail=' "VC" "angel" "investor"'),
        quoted(what, lead="site:news.ycombinator.com "),
        quoted(who, lead="site:news.ycombinator.com "),
    ))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
