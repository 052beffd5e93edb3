"""Profile pages with whole documents as their free text, taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import pages as P
from siltwork.plans.frames import dealt, table
from siltwork.plans.registry import query


def pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-together pages: a header, each document as the text about a person, sections, and noise."""
    n = F.col("doc_id")
    raw = F.concat(
        F.lit("Person "), n, F.lit("· 1st· 2ndCofounder of Acme "), n % 50, F.lit(" | Builder\nParis, France·Contact info\n500+ connectionsMessageAbout"), F.coalesce("text", F.lit("")),
        F.lit("ActivityPostsWe are building in the open every day\nshortExperienceEngineer at Co"), n % 7, F.lit(" · Full-time\nSecond role of theirsEducationUniversity "), n % 11,
        F.lit("\nDegree in somethingSkillsSQL\nRustLanguagesFrench\nNative proficiency https://github.com/u"), n, F.lit(" https://p"), n, F.lit(".dev/).More profiles for youSomebody else LinkedIn Corporation"),
    )
    return dealt(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id")


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in lines, with each document behind its label."""
    n = F.col("doc_id")
    raw = F.concat(
        F.lit("Person "), n, F.lit("\nFounder at Firm "), n % 50, F.lit("\nAmsterdam, Netherlands\nExperience\nFirst job  Second job\tThird job\nFourth job\nEducation\nUniversity "), n % 11,
        F.lit("\nSkills\nSQL\nGo\nPython\nPosts\n"), F.coalesce("text", F.lit("")), F.lit("\nLicenses\nhttps://www.linkedin.com/company/firm"), n % 50, F.lit(". https://firm"), n % 50, F.lit(".io"),
    )
    return dealt(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id")


def shown(profile: str = "profile") -> list[Column]:
    """All fields of a profile; long texts and lists as digests."""
    whole = ("about", "raw", "current_roles", "past_roles", "experience", "education", "skills", "languages", "posts", "links", "hn_names", "github_names", "product_hunt_names")
    texts = [F.col(f"{profile}.{f}").alias(f) for f in P.FIELDS if f not in whole]
    digests = [F.sha2(F.col(f"{profile}.{f}") if f in ("about", "raw") else F.array_join(f"{profile}.{f}", "\n"), 256).alias(f"{f}_sha256") for f in whole]
    return texts + digests


@query()
def pasted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of run-together pages, ``about`` and ``raw`` as shown and in full; taking them apart is beyond SQL."""
    rows = P.pasted_profiles(pastes(spark, sf_dir), "raw", whole="whole")
    return rows.select("doc_id", P.looks_pasted(F.col("raw")).alias("pasted"), *shown(), *[F.sha2(f"whole.{f}", 256).alias(f"whole_{f}_sha256") for f in ("about", "raw")])


@query()
def lined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of pages in lines."""
    return P.lined_profiles(lined(spark, sf_dir), "raw", as_one_line=False).select("doc_id", *shown())
