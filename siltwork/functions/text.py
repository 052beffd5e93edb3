"""Text expressions: filters, redaction, names, hosts, quotes; and vectors as bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that mark adverts for jobs, questions, promotions and builders.
JOB_AD = r"(?i)\b(we'?re hiring|now hiring|job opening|apply now|send your (cv|resume)|who'?s hiring|seeking candidates|full[- ]time position|job alert|remote position|competitive salary|benefits package)\b"
QUESTION = r"(?i)^(ask hn|question|does anyone know|how do i|what'?s the best|looking for recommendations|eli5)\b"
PROMO = r"(?i)\b(discount code|coupon|black friday|limited time offer|buy now|affiliate link|sponsored post|giveaway)\b"
BUILDER = r"(?i)\b(i|we) (built|made|created|launched|shipped|founded|started|am building|are building|'?ve built)\b|\bmy (startup|company|product|saas)\b|\bour (startup|company|product)\b|\bbootstrapped\b|\bsold (my|our) company\b"
#: Words that promote a message, hosts that are no company, platforms by suffix.
LEAD_HINTS = ("raised", "raising", "launched", "launching", "building", "built", "founded", "co-founder", "cofounder", "founder", "startup", "seed", "pre-seed", "series a", "yc ", "demo day", "pitch", "spun out", "stealth", "hiring", "shipped")
NOT_A_COMPANY = (
    "news.ycombinator.com", "substack.com", "reddit.com", "twitter.com", "x.com", "medium.com", "youtube.com", "youtu.be", "lobste.rs", "producthunt.com",
    "dev.to", "hashnode.dev", "linkedin.com", "github.com", "gitlab.com", "apps.apple.com", "play.google.com", "chromewebstore.google.com",
    "addons.mozilla.org", "marketplace.visualstudio.com", "npmjs.com", "pypi.org", "theverge.com", "techcrunch.com", "wired.com", "arstechnica.com",
    "nytimes.com", "bloomberg.com", "reuters.com", "forbes.com", "businessinsider.com", "docs.google.com", "drive.google.com", "notion.so", "imgur.com",
    "archive.org", "web.archive.org", "en.wikipedia.org", "bit.ly", "t.co",
)
HOSTING_SUFFIXES = (
    ".substack.com", ".vercel.app", ".netlify.app", ".herokuapp.com", ".pages.dev", ".github.io", ".gitlab.io", ".notion.site", ".webflow.io", ".framer.website",
    ".myshopify.com", ".wordpress.com", ".blogspot.com", ".medium.com", ".streamlit.app", ".onrender.com", ".fly.dev", ".workers.dev", ".replit.app",
)
MAIL_CUTS = ("\n-----original message-----", "\n--- forwarded message ---", "\n---------- forwarded message ----------", "\nsent from my ", "\nunsubscribe", "\nconfidentiality notice")
#: Words end at what is no letter, number or underscore of any script, so that "ça" stays whole.
NAME_NOISE = r"(?<![\p{L}\p{N}_])(inc|llc|ltd|gmbh|bv|ab|oy|corp|co|the|a|an)(?![\p{L}\p{N}_])\.?"
#: What redaction replaces.
EMAIL, PHONE, HANDLE = r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", r"[+(]?\d[\d\s().-]{6,}\d", r"[@~]\w[\w.-]*"
URL = r"https?://[^\s<>\"')]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def any_term(text: Column, terms: Sequence[str], lowered: bool = False) -> Column:
    """Whether a text, lower-cased unless it is so already, contains one of some terms; null if it is null."""
    low = text if lowered else F.lower(text)
    out = F.lit(False)
    for term in terms:
        out = out | low.contains(term.lower())
    return out


def term_hits(text: Column, terms: Sequence[str], lowered: bool = False) -> Column:
    """The terms that a text, lower-cased unless it is so already, contains, in the order of the list.

    The text is lower-cased once: a condition for each term would do so again for each.
    """
    named = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low")) for t in terms])
    hits = lambda low: F.transform(F.filter(named, lambda t: low.contains(t["low"])), lambda t: t["term"])
    return hits(text) if lowered else F.flatten(F.transform(F.array(F.lower(text)), hits))


def is_lead(text: Column, hints: Sequence[str] = LEAD_HINTS) -> Column:
    return text.rlike(r"https?://\S+") | any_term(text, hints)


def scrub(text: Column) -> Column:
    """Addresses, numbers and handles replaced, in this order, then white space runs of two or more."""
    masked = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[email]")).otherwise(text)
    masked = F.regexp_replace(F.regexp_replace(masked, PHONE, "[phone]"), HANDLE, "[handle]")
    return strip(F.regexp_replace(masked, r"\s{2,}", " "))


def fragment(text: Column, hints: Sequence[str] = LEAD_HINTS, names: Sequence[str] = (), most: int = 400) -> Column:
    """Sentences that carry a lead, or else the first one: scrubbed, names masked, cut."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda p: p != "")
    leads = F.filter(parts, lambda p: is_lead(p, hints))
    out = scrub(F.array_join(F.when(F.size(leads) > 0, leads).otherwise(F.slice(parts, 1, 1)), " "))
    for name in sorted((n for n in names if len(n) > 2), key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"(?i)\b\Q{name}\E\b", "[name]")
    return F.substring(out, 1, most)


def normal_name(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, NAME_NOISE, ""), "[^a-z0-9]+", "")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def company_domain(url: Column) -> Column:
    """The host, or null if it names no company of its own."""
    h = host(url)
    hosted = F.lit(False)
    for suffix in HOSTING_SUFFIXES:
        hosted = hosted | h.endswith(suffix)
    return F.when((h != "") & ~h.isin(*NOT_A_COMPANY) & ~hosted, h)


def profile_handle(url: Column) -> Column:
    """struct(kind, value) of a GitHub owner or a LinkedIn person or company page, or null."""
    h, path = host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    owner = F.lower(F.regexp_extract(path, r"^/+([^/]+)", 1))
    slug = F.lower(F.regexp_extract(path, r"^/+(?:in|company)/+([^/]+)", 1))
    value = F.when(h == "github.com", owner).when(h == "linkedin.com", slug)
    kind = F.regexp_replace(h, r"\.com$", "")
    return F.when(F.coalesce(value, F.lit("")) != "", F.struct(kind.alias("kind"), value.alias("value")))


def links(text: Column) -> Column:
    """Distinct links of a text, closing punctuation off."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), 1), lambda u: F.regexp_replace(u, r"[.,)]+$", "")))


def quote_in(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, white space and case aside; a blank one never does."""
    return (strip(quote) != "") & squash(F.coalesce(text, F.lit(""))).contains(squash(quote))


def claim_in(claim: Column, text: Column, passes: Sequence[str] = ("", "n/a", "unknown", "none")) -> Column:
    """Whether the start of a claim stands in a text, links without scheme; some words always pass."""
    plain = F.regexp_replace(F.lower(strip(claim)), r"^https?://|/+$", "")
    return plain.isin(*passes) | F.lower(text).contains(F.substring(plain, 1, 40))


def mail_body(text: Column, cuts: Sequence[str] = MAIL_CUTS) -> Column:
    """The text above the earliest marker that does not stand at the very start."""
    low = F.lower(text)
    places = F.array_min(F.filter(F.array(*[F.instr(low, c) for c in cuts]), lambda p: p > 1))
    return strip(F.when(places.isNotNull(), F.substring(text, F.lit(1), places - 1)).otherwise(text))


def tags_off(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate_middle(text: Column, most: int) -> Column:
    left, right = (most - 3 + 1) // 2, (most - 3) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, left), F.lit("..."), F.right(text, F.lit(right))))


def fnv32(text: Column) -> Column:
    """FNV-1a of 32 bits over the units of UTF-16, as hexadecimal of eight digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    value = F.aggregate(codes, F.lit(2166136261), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def json_object(text: Column) -> Column:
    """The widest brace-to-brace part of a chatty answer, or null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


#: Points and topics of a project description.
README_TOPICS = ((r"example|usage|quickstart|getting started", 9), (r"install|setup|requirements|prerequisites", 7), (r"license|mit|apache", 4), (r"contribut|pull request|issue tracker", 5))


def readme_quality(text: Column) -> Column:
    """Points for length, headings, code, links and topics, 100 at most, halves up; 0 without text."""
    low = F.lower(text)
    topics = sum((F.when(low.rlike(p), v).otherwise(0) for p, v in README_TOPICS), F.lit(0))
    points = (
        F.least(F.length(text) / 80, F.lit(35.0))
        + F.least(F.regexp_count(text, F.lit(r"(?m)^#+\s")) * 2, F.lit(15))
        + F.least(F.regexp_count(text, F.lit("```")) * 2.0, F.lit(15.0))
        + F.least(F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)")) * 1.5, F.lit(10.0))
    )
    return F.coalesce(F.floor(F.least(points + topics, F.lit(100.0)) + 0.5), F.lit(0)).cast("long")


def packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the vector as bytes of little-endian 32-bit floats; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if v is None else v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() for v in (x if x.is_valid else None for x in batch.column(vector))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], names=[key, vector])

    return rows.select(key, vector).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {vector} binary")


def unpacked(rows: DataFrame, key: str, blob: str) -> DataFrame:
    """key and the vector that bytes of 32-bit floats hold; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if b is None else np.frombuffer(b, "<f4") for b in batch.column(blob).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float32()))], names=[key, blob])

    return rows.select(key, blob).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {blob} array<float>")
