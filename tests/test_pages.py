"""Profile pages against a plain reading of them, line by line."""

import hashlib
import re

from pyspark.sql import functions as F

from siltwork.functions import pages as P
from siltwork.plans import pages as plans


def clean(s):
    return re.sub(r"[\s\xa0]+", " ", s).strip(" ")


def cut_at(text, pattern):
    found = re.search(pattern, text)
    return text[: found.start()] if found else text


def distinct(values):
    return list(dict.fromkeys(values))


def links(text, most):
    return distinct(re.sub(r"[),.]+$", "", u) for u in re.findall(r"https?://[^\s)\"']+", text, re.I))[:most]


def own(urls):
    return next((u for u in urls if not any(h in u for h in P.NOT_OWN)), "")


def names(text, out):
    for field, key in (("hn_names", "hn"), ("github_names", "github"), ("product_hunt_names", "product_hunt")):
        out[field] = distinct(re.findall(P.ACCOUNTS[key], text))


def pasted(text, title=""):
    body = cut_at(text or "", P.TEXT_ENDS)
    broken = body
    for label in P.LABELS:
        broken = re.sub(r"(\S)" + re.escape(label) + r"(?=[A-Z]|\s)", lambda m: f"{m[1]}\n{label}\n", broken)
    for pattern in P.NOISE:
        broken = re.sub(pattern, " ", broken, flags=re.A)
    broken = broken[:60_000]
    lines = [line for line in map(clean, broken.split("\n")) if line]
    opens = [bool(re.match(P.SECTION, line)) for line in lines]
    header = []
    if False in opens:
        for line, label in list(zip(lines, opens))[opens.index(False) :]:
            if label or len(header) == 6:
                break
            header.append(line)
    sections = {}
    for name, (label, least, most, cut) in P.SECTIONS.items():
        found = []
        for i, line in enumerate(lines):
            if re.match(label, line):
                found = []
                for entry, stop in zip(lines[i + 1 :], opens[i + 1 :]):
                    if stop:
                        break
                    found.append(entry)
        found = [e for e in found if len(e) > 1 and len(e) >= least and not (name == "languages" and re.search("proficiency", e, re.I))][:most]
        sections[name] = [e[:cut] for e in found]
    top = re.split(P.DEGREE, (header[0] if header else title).strip())
    tail = clean(re.sub(P.CONTACT, " ", " ".join(top[1:])))
    out = {"name": clean(top[0]), "headline": re.sub(r"\s{2,}", " ", re.sub(r"\bContact info\b", "", tail, count=1, flags=re.I)).strip(" ")}
    place = next((line for line in header[1:] if re.search(P.PLACE_COMMA, line) and not re.search(P.NO_PLACE, line)), "")
    out["location"] = clean(re.sub(r"^[·\s]+", "", re.sub(r"(?i)·\s*Contact info.*$", "", place)))
    named = re.search(P.COMPANY_OF, out["headline"]) or re.search(P.COMPANY_AT, out["headline"])
    company = re.sub(r"\s*[|·].*$", "", clean(named[1])) if named else ""
    if not company:
        job = re.split(r"(?i)\bat\b|·", next((e for e in sections["experience"] if re.search(r"\bat\b|\b·\b", e)), ""))
        company = re.split(r"\s*[|·]", clean(job[1]) if len(job) > 1 else "")[0]
    urls = links(text or "", 60)
    out |= {"company": company, "company_url": next((u for u in urls if re.search(P.COMPANY_LINK, u)), ""), "website": own(urls), "raw": body[:8000], "links": urls}
    out |= {"about": clean(" ".join(sections["about"]))[:1500], "current_roles": sections["experience"][:2], "past_roles": sections["experience"][2:]}
    out |= {s: sections[s] for s in ("experience", "education", "skills", "languages", "posts")}
    names(broken, out)
    return out


def lined(text, title="", one_line=True):
    raw = (clean(text or "") if one_line else (text or "").strip(" "))[:40_000]
    lines = [line for line in map(clean, re.split(r"(?:\n| {2,}|\t)+", raw)) if line][:500]
    out = {"name": next((line for line in lines if len(line) > 1), re.sub(r"(?i)\| LinkedIn.*$", "", title).split(" - ")[0])}
    out["headline"] = next((line for line in lines if re.search(P.ROLE, line) and line != out["name"]), re.sub(r"(?i)\| LinkedIn.*$", "", " - ".join(title.split(" - ")[1:])))
    out["location"] = next((line for line in lines if re.search(P.PLACES, line)), "")
    at = next((i for i, line in enumerate(lines) if line.lower() == "about"), None)
    out["about"] = (clean(" ".join(lines[at + 1 : at + 5]))[:1200] if at is not None else "") or " ".join(lines[:12])[:1200]
    for name, (label, stop, most, cut) in P.LINE_SECTIONS.items():
        start = next((i for i, line in enumerate(lines) if re.match(label, line)), None)
        found = []
        for line in lines[start + 1 :] if start is not None else ():
            if re.match(stop, line) or len(found) == most:
                break
            if len(line) > 2:
                found.append(line[:cut])
        out[name] = found
    job = next((line for line in lines if re.search(P.ROLE_AT, line)), next((line for line in lines if re.search(P.AT, line)), ""))
    firm = re.search(r"\bat\s+(.{2,80})$", job, re.I)
    urls = links(raw, 80)
    out |= {"company": clean(firm[1]) if firm else "", "company_url": next((u for u in urls if re.search(r"(?i)https?://(?:www\.)?linkedin\.com/company/[^\s)\"']+", u)), ""), "website": own(urls)}
    out |= {"raw": raw, "links": urls, "languages": [], "current_roles": out["experience"][:3], "past_roles": out["experience"][3:]}
    names(raw, out)
    return out


PASTE = (
    "Ada Lovelace· 1st· 2ndCofounder of Engine | Junior at University of LondonStealth · University of London\nLondon, Greater London, England·Contact infoStealth500+ connections"
    "Bartu and 258 other mutual connectionsMessageHighlightsYou both studied at a collegeAboutThird year mathematics student. Working on machines.Activity1,212 followersPostsCommentsAda Lovelace • 1st"
    "Mehmet and I are building Engine.ExperienceCo-founderStealth · Full-timeApr 2026 - Present · 3 mosVice PresidentSenateEducationUniversity of London\nBachelor's degree, MathematicsHonors & awards"
    "Olympiad team member\nIssued in 2023Show all 3 honors & awardsLanguagesGerman\nElementary proficiencyFrenchInterestsTop VoicesCompaniesSchoolsSomebody · 2ndFollowAd OptionsWhy am I seeing this ad?"
    "More profiles for youAl Cay · 2ndConnectAboutAccessibilityTalent SolutionsLinkedIn Corporation"
)
ODD = [
    None, "", " \n\t", "About", "About\nAbout\nfirst words\nAbout\nsecond words", "Just one line", "Experience\nEngineer at Acme · Full-time\nx\nSkills\na\nbb", PASTE, PASTE.replace("Cofounder of Engine | ", ""),
    "Name - x\nCEO at Big Corp | y\nBerlin", "a b\nSkillsSQL", "Posts\n" + "word " * 300 + "\nshort", "x" * 50_000, "see https://a.io/). and HTTPS://github.com/Me, news.ycombinator.com/user?id=me producthunt.com/@me",
]


def rows_of(profile):
    return {f: profile[f] for f in P.FIELDS}


def test_pastes(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    got = {r["id"]: r["profile"].asDict() for r in P.pasted_profiles(docs).collect()}
    for i, text in enumerate(ODD):
        assert got[i] == rows_of(pasted(text)), (i, text)
    ada = got[ODD.index(PASTE)]
    assert ada["name"] == "Ada Lovelace" and ada["headline"].startswith("Cofounder of Engine") and ada["company"] == "Engine"
    assert "Third year mathematics" in ada["about"] and any("University of London" in e for e in ada["education"]) and ada["experience"]
    for word in ("LinkedIn Corporation", "More profiles for you", "Ad Options"):
        assert word not in ada["raw"] and word not in ada["about"]
    assert docs.select(P.looks_pasted(F.col("text")).alias("p")).collect()[ODD.index(PASTE)]["p"]


def test_lines(spark):
    docs = spark.createDataFrame([(i, t, f"Title {i} - of page | LinkedIn 3", "c") for i, t in enumerate(ODD)], "id int, text string, title string, profile string")
    for one_line in (True, False):
        got = {r["id"]: r["found"].asDict() for r in P.lined_profiles(docs.drop("profile"), title="title", as_one_line=one_line).withColumnRenamed("profile", "found").collect()}
        for i, text in enumerate(ODD):
            assert got[i] == rows_of(lined(text, f"Title {i} - of page | LinkedIn 3", one_line)), (i, text)


def digest(value):
    return hashlib.sha256(("\n".join(value) if isinstance(value, list) else value).encode()).hexdigest()


def test_queries(spark):
    data = "/root/testdata/sf0.001"
    for made, query, plain in ((plans.pastes, plans.pasted_pages, pasted), (plans.lined, plans.lined_pages, lambda t: lined(t, one_line=False))):
        texts = {r["doc_id"]: r["raw"] for r in made(spark, data).collect()}
        for r in query(spark, data).collect():
            want = plain(texts[r["doc_id"]])
            for f in P.FIELDS:
                assert (r[f] == want[f]) if f in r.asDict() else (r[f"{f}_sha256"] == digest(want[f])), (r["doc_id"], f)


def test_every_kind_of_noise_has_its_letters():
    samples = ("Show all 9 posts", "1,234+ connections", "12 followers", "Mutual connection x", "Send InMail now", "More action", "· Full-time", "Follow")
    for letters, pattern, sample in zip(P.NOISE_LETTERS, P.NOISE, samples, strict=True):
        assert letters in sample and re.search(pattern, sample)


def test_labels_one_behind_the_other(spark):
    """A label counts only behind what is no white space and not the label found last, as if that character were taken too."""
    texts = ["xAboutAbout yAbout Z", "AboutAboutAboutAbout A", "😀SkillsSkillsSQL", "aPostsbPosts Posts Posts\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    taken, found = F.col("t"), rows.withColumn("__plain", F.col("t"))
    for label in P.LABELS:
        taken = F.regexp_replace(taken, rf"(\S)\Q{label}\E(?=[A-Z]|\s)", f"$1\n{label}\n")
        found = P.labelled(found, label)
    assert [r[0] for r in found.select("__plain").collect()] == [r[0] for r in rows.select(taken).collect()]


def test_whole_pastes(spark):
    """Nothing is left out of a text of any length: what comes late, many entries and links, long posts, about and raw in full."""
    body = "".join(f"word{i} " for i in range(20_000))
    jobs, schools, skills, tongues, posts = ([f"{w} number {i}" for i in range(40)] for w in ("Engineer", "University", "Skill", "Tongue", "Post of ours"))
    posts[0] = "long " * 300 + "end"
    sites = [f"https://p{i}.dev" for i in range(90)]
    made = ["Ada· 1stCofounder of Engine", "About", body, "Experience", *jobs, "Education", *schools, "Skills", *skills, "Languages", *tongues, "Posts", *posts, "see github.com/late and " + " ".join(sites)]
    text = "\n".join([*made, "https://www.linkedin.com/company/engine", "More profiles for you", "Bob"])
    row = P.pasted_profiles(spark.createDataFrame([(text,), (None,)], "text string"), whole="full").orderBy(F.col("text").isNull()).collect()
    got, full = row[0]["profile"], row[0]["full"]
    assert len(body) > 150_000 and full["about"] == clean(body) and full["raw"] == text[: text.index("More profiles")]
    assert got["about"] == full["about"][:1500] and got["raw"] == full["raw"][:8000]
    assert (got["experience"], got["education"], got["skills"], got["languages"]) == (jobs, schools, skills, tongues)
    assert got["current_roles"] + got["past_roles"] == jobs and got["posts"][:40] == posts
    assert got["links"] == [*sites, "https://www.linkedin.com/company/engine"] and got["company_url"] == got["links"][-1] and got["github_names"] == ["late"]
    assert row[1]["full"].asDict() == {"about": "", "raw": ""} and row[1]["profile"]["links"] == []
