"""Fields of a person out of the visible text of a profile page: run-together pastes and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the page's own text ends, what stands before a section, what opens one, and noise.
TEXT_ENDS = r"(?i)Ad Options|More profiles for you|People you may know|You might like|Pages for you|About\s+Accessibility\s+Talent|Recommendation transparency|Select language|LinkedIn Corporation|Manage your account and privacy"
LABELS = (
    "About", "Activity", "Posts", "Comments", "Featured", "Highlights", "Experience", "Education", "Licenses & certifications", "Honors & awards", "Honors and awards", "Skills",
    "Languages", "Interests", "Top Voices", "Companies", "Schools", "Causes", "Contact info", "Volunteering", "Publications", "Projects", "Recommendations",
)
SECTION = (
    "(?i)^(About|Activity|Posts|Featured|Highlights|Experience|Education|Honors & awards|Honors and awards|Skills|Languages|Interests|Top Voices|Companies|Schools|Causes|Volunteering"
    "|Publications|Projects|Recommendations|Contact info|Licenses & certifications)$"
)
NOISE = (
    r"Show all\b[^\n]*", r"\b\d+(?:,\d{3})*\+? connections\b", r"\b\d+(?:,\d{3})* followers\b", r"\bMutual connections?\b[^\n]*", r"\bSend (InMail|profile)\b[^\n]*",
    r"\bMore actions?\b[^\n]*", r"·\s*(Self-employed|Full-time|Part-time|Contract|Internship|Freelance)", r"(?im)^\s*(Message|Connect|Follow|Following)\s*$",
)
#: Letters that a text with that noise never lacks.
NOISE_LETTERS = ("Show all", " connections", " followers", "Mutual connection", "Send ", "More action", "·", "")
DEGREE, CONTACT = r"·\s*(?:1st|2nd|3rd)", r"(·\s*1st|·\s*2nd|·\s*3rd|·\s*Contact info)"
NO_PLACE, PLACE_COMMA = "(?i)Cofounder|founder|engineer|student|building|cto|ceo", r",\s*[A-Za-zÀ-ɏ]"
COMPANY_OF, COMPANY_AT = r"(?i)(?:cofounder|co-founder|founder|ceo|cto|building)\s+(?:of|at)\s+([A-Za-z0-9 .&'-]{2,60})", r"\b(?:at|@)\s+([A-Z][A-Za-z0-9 .&'-]{2,60})"
LINK, LINK_TAIL, COMPANY_LINK = r"(?i)https?://[^\s)\"']+", r"[),.]+$", "(?i)linkedin\\.com/company/"
NOT_OWN = ("linkedin.com", "github.com", "news.ycombinator.com")
ACCOUNTS = {"github": r"(?i)github\.com/([A-Za-z0-9_.-]+)", "hn": r"(?i)news\.ycombinator\.com/user\?id=([A-Za-z0-9_-]+)", "product_hunt": r"(?i)producthunt\.com/@([A-Za-z0-9_-]+)"}
#: Of each section its labels, the least length of an entry, how many entries and how much of each (None: all).
SECTIONS = {
    "about": ("(?i)^about$", 2, None, None), "posts": ("(?i)^(activity|posts)$", 13, None, None), "experience": ("(?i)^experience$", 5, None, None), "education": ("(?i)^education$", 5, None, None),
    "skills": ("(?i)^skills$", 2, None, None), "honors": (r"(?i)^(honors\s*&\s*awards|honors and awards)$", 5, None, None), "languages": ("(?i)^languages$", 2, None, None),
}
#: Code points of a pasted page's text and of its section about that are shown in a profile.
SHOWN_RAW, SHOWN_ABOUT = 8000, 1500
#: Fixed values of pages in lines: roles, places, and of each section its label, where it stops, how many entries and how much of each.
ROLE = r"(?i)\b(founder|co-founder|ceo|cto|investor|builder|engineer|operator|student)\b"
ROLE_AT, AT = r"(?i)\b(founder|co-founder|ceo|cto|building|owner)\b.+\bat\b", r"\bat\s+[A-Z][A-Za-z0-9 .&-]{2,}"
PLACES = r"(?i)\b(Netherlands|Amsterdam|Istanbul|Turkey|United States|London|Berlin|Paris|San Francisco|New York)\b"
LINE_SECTIONS = {
    "experience": ("(?i)^experience$", "(?i)^(education|activity|posts|skills|licenses|recommendations)$", 12, None), "education": ("(?i)^education$", "(?i)^(experience|activity|posts|skills|licenses|recommendations)$", 8, None),
    "posts": ("(?i)^(activity|posts)$", "(?i)^(experience|education|skills|licenses|recommendations)$", 10, 700), "skills": ("(?i)^skills$", "(?i)^(experience|education|activity|posts|licenses|recommendations)$", 20, None),
}
PASTE = r"(?i)·\s*(?:1st|2nd|3rd)|mutual connections?|contact info"
FIELDS = ("name", "headline", "location", "about", "company", "company_url", "website", "raw", "current_roles", "past_roles", "experience", "education", "skills", "languages", "posts", "links", "hn_names", "github_names", "product_hunt_names")


def none() -> Column:
    return F.array().cast("array<string>")


def clean(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{a0}]+", " "))


def first(values: Column, holds) -> Column:
    """The first of a list for which something holds, or null."""
    return F.get(F.filter(values, holds), F.lit(0))


def replaced(rows: DataFrame, letters: str, pattern: str, by: str) -> DataFrame:
    """``__plain`` with a pattern replaced, which no text without some letters can hold."""
    plain = F.col("__plain")
    return rows.withColumn("__plain", F.when(plain.contains(letters), F.regexp_replace(plain, pattern, by)).otherwise(plain))


def labelled(rows: DataFrame, label: str) -> DataFrame:
    """``__plain`` with a label in running text on a line of its own.

    Found by its letters, then by what stands before: no white space, and not the label found last.
    """
    return replaced(rows, label, rf"\Q{label}\E(?<=\S\Q{label}\E)(?<!\G\Q{label}\E)(?=[A-Z]|\s)", f"\n{label}\n")


def titled(line: Column, pattern: str) -> Column:
    """Whether a cleaned line is one of some titles. Titles are short, so long lines are not tried."""
    return (F.octet_length(line) <= 160) & line.rlike(pattern)


def until(lines: Column, stop: str) -> Column:
    """Lines up to the first that is a title which stops them."""
    at = F.array_position(F.transform(lines, lambda line: titled(line, stop)), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)


def after(lines: Column, at: Column) -> Column:
    """Lines behind the place ``at`` (from 1)."""
    return F.slice(lines, at.cast("int") + 1, F.size(lines))


def links(given: Column, text: Column, most: int | None = None) -> Column:
    """Distinct links, the given ones first, without brackets and stops at their ends; all unless ``most`` is given."""
    found = F.concat(F.coalesce(given, none()), F.regexp_extract_all(text, F.lit(f"({LINK})"), 1))
    distinct = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, LINK_TAIL, "")))
    return F.slice(distinct, 1, most) if most else distinct


def own_site(urls: Column) -> Column:
    return F.coalesce(first(urls, lambda u: ~(u.contains(NOT_OWN[0]) | u.contains(NOT_OWN[1]) | u.contains(NOT_OWN[2]))), F.lit(""))


def accounts(text: Column, name: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ACCOUNTS[name]), 1))


def pasted_profiles(rows: DataFrame, text: str = "text", title: str | None = None, given: str | None = None, whole: str | None = None) -> DataFrame:
    """Adds ``profile``, a struct of FIELDS, from run-together page text: sections end where labels stand.

    The whole text is taken apart, and all entries and links are returned. Only ``about`` and
    ``raw`` are shown by their first 1,500 and 8,000 code points; ``whole`` names a column to
    be added with both in full, a struct of ``about`` and ``raw``.

    What follows the page's own text goes; labels in running text become lines of their own;
    buttons and counters go. Up to six lines before the first section are the header. Of a
    section that comes twice the later one counts. ``title`` and ``given`` name columns with
    the page's title and a list of links, if there are any. A null text is empty; lengths are
    code points. All is done by expressions, row by row, without a shuffle.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = rows.withColumn("__cut", F.get(F.split(raw, TEXT_ENDS, 2), F.lit(0)))
    kept = kept.withColumn("__plain", F.col("__cut"))
    # Each step is a column of its own, and passes over a text without the letters it needs.
    for label in LABELS:
        kept = labelled(kept, label)
    for letters, pattern in zip(NOISE_LETTERS, NOISE):
        kept = replaced(kept, letters, pattern, " ")
    kept = kept.withColumn("__lines", F.filter(F.transform(F.split("__plain", r"\n+"), clean), lambda line: line != ""))
    start = F.array_position(F.transform("__lines", lambda line: titled(line, SECTION)), False)
    header = F.when(start > 0, F.slice(until(after(F.col("__lines"), start - 1), SECTION), 1, 6)).otherwise(none())
    kept = kept.withColumns({"__header": header, **{f"__{name}": _section(name) for name in SECTIONS}})
    parts = F.split(F.trim(F.coalesce(F.get("__header", F.lit(0)), F.col(f"`{title}`") if title else F.lit(""), F.lit(""))), DEGREE)
    tail = clean(F.regexp_replace(F.array_join(after(parts, F.lit(1)), " "), CONTACT, " "))
    headline = F.trim(F.regexp_replace(F.regexp_replace(tail, r"(?i)^(.*?)\bContact info\b", "$1"), r"\s{2,}", " "))
    place = first(after(F.col("__header"), F.lit(1)), lambda line: line.rlike(PLACE_COMMA) & ~line.rlike(NO_PLACE))
    location = clean(F.regexp_replace(F.regexp_replace(F.coalesce(place, F.lit("")), r"(?i)·\s*Contact info.*$", ""), r"^[·\s]+", ""))
    urls = links(F.col(f"`{given}`") if given else none(), raw)
    kept = kept.withColumns({"__headline": headline, "__links": urls, "__all_about": clean(F.array_join("__about", " "))})
    h = F.col("__headline")
    named = F.when(F.regexp_extract(h, COMPANY_OF, 1) != "", F.regexp_extract(h, COMPANY_OF, 1)).otherwise(F.regexp_extract(h, COMPANY_AT, 1))
    company = F.regexp_replace(clean(named), r"\s*[|·].*$", "")
    job = first(F.col("__experience"), lambda line: line.rlike(r"\bat\b|\b·\b"))
    employer = F.coalesce(F.get(F.split(clean(F.get(F.split(F.coalesce(job, F.lit("")), r"(?i)\bat\b|·"), F.lit(1))), r"\s*[|·]"), F.lit(0)), F.lit(""))
    values = {
        "name": clean(F.get(parts, F.lit(0))), "headline": h, "location": location, "about": F.substring("__all_about", 1, SHOWN_ABOUT), "company": F.when(company != "", company).otherwise(employer),
        "company_url": F.coalesce(first(F.col("__links"), lambda u: u.rlike(COMPANY_LINK)), F.lit("")), "website": own_site(F.col("__links")), "raw": F.substring("__cut", 1, SHOWN_RAW),
        "current_roles": F.slice("__experience", 1, 2), "past_roles": after(F.col("__experience"), F.lit(2)), **{c: F.col(f"__{c}") for c in ("experience", "education", "skills", "languages", "posts", "links")},
        "hn_names": accounts(F.col("__plain"), "hn"), "github_names": accounts(F.col("__plain"), "github"), "product_hunt_names": accounts(F.col("__plain"), "product_hunt"),
    }
    full = [F.struct(F.col("__all_about").alias("about"), F.col("__cut").alias("raw")).alias(whole)] if whole else []
    return kept.withColumn("profile", F.struct(*[values[f].alias(f) for f in FIELDS])).select(*[f"`{c}`" for c in rows.columns], "profile", *full)


def _section(name: str) -> Column:
    """Entries of the last section of a name, or none."""
    label, least, most, cut = SECTIONS[name]
    marks = F.transform("__lines", lambda line: titled(line, label))
    last = F.size("__lines") - F.array_position(F.reverse(marks), True) + 1
    entries = F.filter(until(after(F.col("__lines"), last), SECTION), lambda line: (F.length(line) > 1) & (F.length(line) >= least))
    if name == "languages":
        entries = F.filter(entries, lambda line: ~line.rlike("(?i)proficiency"))
    entries = F.slice(entries, 1, most) if most else entries
    entries = F.transform(entries, lambda line: F.substring(line, 1, cut)) if cut else entries
    return F.when(F.array_contains(marks, True), entries).otherwise(none())


def lined_profiles(rows: DataFrame, text: str = "text", title: str | None = None, given: str | None = None, as_one_line: bool = True) -> DataFrame:
    """Adds ``profile``, a struct of FIELDS, from page text in lines: a section runs from its label to a line that stops it.

    Lines end at line feeds, tabs and runs of two spaces. ``as_one_line`` first takes all white
    space as one space, so that a text is one line and has no sections; this is the usual form.
    ``title`` and ``given`` as in ``pasted_profiles``. A null text is empty.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    heading = F.coalesce(F.col(f"`{title}`"), F.lit("")) if title else F.lit("")
    kept = rows.withColumn("__raw", F.substring(clean(raw) if as_one_line else F.trim(raw), 1, 40_000))
    kept = kept.withColumn("__lines", F.slice(F.filter(F.transform(F.split("__raw", r"(?:\n| {2,}|\t)+"), clean), lambda line: line != ""), 1, 500))
    lines = F.col("__lines")
    named = F.get(F.split(F.regexp_replace(heading, r"(?i)\| LinkedIn.*$", ""), " - "), F.lit(0))
    kept = kept.withColumns({"__links": links(F.col(f"`{given}`") if given else none(), F.col("__raw"), 80), "__name": F.coalesce(first(lines, lambda line: F.length(line) > 1), named)})
    kept = kept.withColumns({f"__{name}": _line_section(name) for name in LINE_SECTIONS})
    subtitle = F.regexp_replace(F.array_join(after(F.split(heading, " - "), F.lit(1)), " - "), r"(?i)\| LinkedIn.*$", "")
    about_at = F.array_position(F.transform(lines, lambda line: line.rlike("(?i)^about$")), True)
    labelled = F.when(about_at > 0, F.substring(clean(F.array_join(F.slice(after(lines, about_at), 1, 4), " ")), 1, 1200)).otherwise("")
    job = F.coalesce(first(lines, lambda line: line.rlike(ROLE_AT)), first(lines, lambda line: line.rlike(AT)), F.lit(""))
    values = {
        "name": F.col("__name"), "headline": F.coalesce(F.get(F.filter(lines, lambda line: line.rlike(ROLE) & (line != F.col("__name"))), F.lit(0)), subtitle),
        "location": F.coalesce(first(lines, lambda line: line.rlike(PLACES)), F.lit("")), "about": F.when(labelled != "", labelled).otherwise(F.substring(F.array_join(F.slice(lines, 1, 12), " "), 1, 1200)),
        "company": clean(F.regexp_extract(job, r"(?i)\bat\s+(.{2,80})$", 1)), "company_url": F.coalesce(first(F.col("__links"), lambda u: u.rlike(r"(?i)https?://(?:www\.)?linkedin\.com/company/[^\s)\"']+")), F.lit("")),
        "website": own_site(F.col("__links")), "raw": F.col("__raw"), "current_roles": F.slice("__experience", 1, 3), "past_roles": after(F.col("__experience"), F.lit(3)),
        **{c: F.col(f"__{c}") for c in ("experience", "education", "skills", "posts", "links")}, "languages": none(),
        "hn_names": accounts(F.col("__raw"), "hn"), "github_names": accounts(F.col("__raw"), "github"), "product_hunt_names": accounts(F.col("__raw"), "product_hunt"),
    }
    return kept.withColumn("profile", F.struct(*[values[f].alias(f) for f in FIELDS])).select(*[f"`{c}`" for c in rows.columns], "profile")


def _line_section(name: str) -> Column:
    label, stop, most, cut = LINE_SECTIONS[name]
    at = F.array_position(F.transform("__lines", lambda line: titled(line, label)), True)
    entries = F.slice(F.filter(until(after(F.col("__lines"), at), stop), lambda line: F.length(line) > 2), 1, most)
    entries = F.transform(entries, lambda line: F.substring(line, 1, cut)) if cut else entries
    return F.when(at > 0, entries).otherwise(none())


def looks_pasted(text: Column) -> Column:
    """Whether a pasted text comes from the network's page: its host, or words of its header."""
    head = F.substring(text, 1, 8000)
    words = head.rlike("(?i)connections?") & head.rlike(r"(?i)\bmessage\b") & head.rlike(r"(?i)\bhighlights?\b")
    return F.coalesce(text.rlike(r"(?i)linkedin\.com") | head.rlike(PASTE) | words, F.lit(False))
