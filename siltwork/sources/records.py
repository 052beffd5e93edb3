"""Candidate records and edges to further nodes out of stored answers of public interfaces.

Each function takes a DataFrame with ``node`` and ``body`` (one JSON answer) and is made of
Spark's own JSON and array functions. Records have source, source_url, raw_text, title,
author, node and posted_at; edges have source, node and neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as T

#: Words that mark a page that asks for a login.
CHALLENGES = ("authwall", "checkpoint/challenge", "unusual activity", "please verify", "sign in to continue")
RECORD = ("source", "source_url", "raw_text", "title", "author", "node", "posted_at")

POSTS = "array<struct<canonical_url:string,title:string,description:string,truncated_body_text:string,publishedBylines:array<struct<name:string>>,post_date:string,publication_id:long>>"
RECOMMENDED = "array<struct<recommendedPublication:struct<subdomain:string,name:string>>>"
HITS = "struct<hits:array<struct<objectID:string,title:string,story_title:string,story_text:string,comment_text:string,url:string,author:string,created_at:string,created_at_i:long,points:long,num_comments:long,story_id:long>>>"
REPOS = "struct<items:array<struct<html_url:string,full_name:string,description:string,topics:array<string>,stargazers_count:long,created_at:string,homepage:string,owner:struct<login:string,type:string>>>>"
LISTING = "array<struct<permalink:string,title:string,selftext:string,author:string,created_utc:double>>"
LAUNCHES = "struct<data:struct<posts:struct<edges:array<struct<node:struct<id:string,name:string,tagline:string,url:string,votesCount:long,commentsCount:long,createdAt:string,makers:array<struct<username:string>>>>>>>>"
ITEM = "struct<id:long,type:string,by:string,title:string,text:string,url:string,score:long,time:long,kids:array<long>,parent:long,descendants:long>"


def blank_off(value: Column) -> Column:
    """Null for an empty text."""
    return F.when(value != "", value)


def paragraphs(*parts: Column) -> Column:
    """Parts below each other, a blank line between them, missing ones as empty, ends trimmed."""
    return T.strip(F.concat_ws("\n\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def _items(answers: DataFrame, schema: str, path: str = "answer") -> DataFrame:
    parsed = answers.select("node", F.from_json("body", schema).alias("answer"))
    return parsed.select("node", F.posexplode(path).alias("at", "r"))


def newsletter_posts(answers: DataFrame) -> DataFrame:
    """Records of archive pages; posts without an address are left out, tags of the texts too."""
    r = _items(answers, POSTS).where("coalesce(r.canonical_url, '') != ''")
    body = F.coalesce(blank_off(T.tags_off(F.col("r.description"))), T.tags_off(F.col("r.truncated_body_text")))
    return r.select(
        F.lit("substack").alias("source"),
        F.col("r.canonical_url").alias("source_url"),
        paragraphs(F.col("r.title"), body).alias("raw_text"),
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.get("r.publishedBylines", F.lit(0))["name"].alias("author"),
        "node",
        F.col("r.post_date").alias("posted_at"),
    )


def archive_pages(pages: DataFrame, page_size: int, most: int) -> DataFrame:
    """Posts of numbered archive pages (node, page, posts) up to the first short one and ``most`` in all.

    A page counts if all before it are full; what a page adds beyond ``most`` is cut.
    """
    full = pages.where(F.size("posts") >= page_size).select("node", F.col("page").alias("before"))
    reached = pages.join(full.withColumn("page", F.col("before") + 1), ["node", "page"], "left").where("page = 0 OR before IS NOT NULL")
    gap = pages.join(full.withColumn("page", F.col("before") + 1), ["node", "page"], "left").where("page > 0 AND before IS NULL").groupBy("node").agg(F.min("page").alias("stop"))
    kept = reached.join(gap, "node", "left").where("stop IS NULL OR page < stop")
    return kept.select("node", "page", F.posexplode("posts").alias("at", "post")).where(F.col("page") * page_size + F.col("at") < most)


def newsletter_edges(answers: DataFrame) -> DataFrame:
    r = _items(answers, RECOMMENDED).where("coalesce(r.recommendedPublication.subdomain, '') != ''")
    return r.select(F.lit("substack").alias("source"), "node", F.col("r.recommendedPublication.subdomain").alias("neighbour"))


def forum_hits(answers: DataFrame) -> DataFrame:
    """Records of story searches; each points to its discussion, so a repost elsewhere is no second one."""
    r = _items(answers, HITS, "answer.hits").where("coalesce(r.objectID, '') != ''")
    title = F.coalesce(blank_off(F.col("r.title")), blank_off(F.col("r.story_title")), F.lit(""))
    return r.select(
        F.lit("hackernews").alias("source"),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), "r.objectID").alias("source_url"),
        paragraphs(title, F.coalesce(blank_off(F.col("r.story_text")), F.col("r.comment_text")), F.col("r.url")).alias("raw_text"),
        title.alias("title"),
        F.col("r.author").alias("author"),
        "node",
        F.col("r.created_at").alias("posted_at"),
    )


def forum_edges(answers: DataFrame) -> DataFrame:
    """Nodes of authors, from searches by words only: from author to author the search would drift."""
    r = _items(answers, HITS, "answer.hits").where("startswith(node, 'query:') AND coalesce(r.objectID, '') != '' AND coalesce(r.author, '') != ''")
    return r.select(F.lit("hackernews").alias("source"), "node", F.concat(F.lit("author:"), "r.author").alias("neighbour")).distinct()


def repositories(answers: DataFrame) -> DataFrame:
    """Records of repository searches: name, description, topics, stars, home page; empty parts left out."""
    r = _items(answers, REPOS, "answer.items").where("coalesce(r.html_url, '') != ''")
    stars = F.concat(F.coalesce("r.stargazers_count", F.lit(0)), F.lit(" stars, created "), F.substring(F.coalesce("r.created_at", F.lit("")), 1, 10))
    parts = [blank_off(c) for c in (F.col("r.full_name"), F.col("r.description"), F.array_join("r.topics", " "), stars, F.col("r.homepage"))]
    return r.select(
        F.lit("github").alias("source"),
        F.col("r.html_url").alias("source_url"),
        F.concat_ws("\n\n", *parts).alias("raw_text"),
        F.col("r.full_name").alias("title"),
        F.col("r.owner.login").alias("author"),
        "node",
        F.col("r.created_at").alias("posted_at"),
    )


def repository_edges(answers: DataFrame) -> DataFrame:
    """Nodes of owners that are organizations, from searches only."""
    r = _items(answers, REPOS, "answer.items").where("startswith(node, 'query:') AND r.owner.type = 'Organization' AND coalesce(r.owner.login, '') != ''")
    return r.select(F.lit("github").alias("source"), "node", F.concat(F.lit("org:"), "r.owner.login").alias("neighbour")).distinct()


def community_posts(answers: DataFrame, per_node: int = 60) -> DataFrame:
    """Records of the newest posts of each community, ``per_node`` at most."""
    r = _items(answers, LISTING).where(F.col("at") < per_node)
    return r.select(
        F.lit("reddit").alias("source"),
        F.concat(F.lit("https://reddit.com"), "r.permalink").alias("source_url"),
        paragraphs(F.col("r.title"), F.col("r.selftext")).alias("raw_text"),
        F.col("r.title").alias("title"),
        F.col("r.author").alias("author"),
        "node",
        F.date_format(F.timestamp_seconds("r.created_utc"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("posted_at"),
    )


def looks_blocked(html: Column) -> Column:
    return T.any_term(F.coalesce(html, F.lit("")), CHALLENGES)


def profile_pages(pages: DataFrame, most: int = 8000) -> DataFrame:
    """Records of profile pages (node, html): the shown text, cut. Pages that ask for a login are left out."""
    return pages.where(~looks_blocked(F.col("html"))).select(
        F.lit("linkedin").alias("source"),
        F.concat(F.lit("https://www.linkedin.com/in/"), "node", F.lit("/")).alias("source_url"),
        F.substring(T.tags_off(F.col("html")), 1, most).alias("raw_text"),
        F.col("node").alias("title"),
        F.col("node").alias("author"),
        "node",
        F.lit(None).cast("string").alias("posted_at"),
    )


def also_viewed(pages: DataFrame, most: int = 8) -> DataFrame:
    """The first distinct profiles that a page links to, and their order."""
    slugs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'/in/([A-Za-z0-9\-%]{3,80})/?"'), 1))
    return pages.where(~looks_blocked(F.col("html"))).select(F.lit("linkedin").alias("source"), "node", F.posexplode(F.slice(slugs, 1, most)).alias("at", "neighbour"))


def launches(answers: DataFrame) -> DataFrame:
    """name, tagline, url, votes, comments, makers, created_at of launch searches."""
    r = _items(answers, LAUNCHES, "answer.data.posts.edges")
    n = "r.node"
    return r.select("node", F.col(f"{n}.name").alias("name"), F.coalesce(f"{n}.tagline", F.lit("")).alias("tagline"), F.col(f"{n}.url").alias("url"), F.coalesce(f"{n}.votesCount", F.lit(0)).alias("votes"), F.coalesce(f"{n}.commentsCount", F.lit(0)).alias("comments"), F.size(F.coalesce(f"{n}.makers", F.array().cast("array<struct<username:string>>"))).alias("makers"), F.col(f"{n}.createdAt").alias("created_at"))


def story_comments(items: DataFrame) -> DataFrame:
    """story, comment, author, text: items (node, body) whose ids the stories list as their children."""
    parsed = items.select(F.from_json("body", ITEM).alias("i")).select("i.*")
    kids = parsed.where("type = 'story'").select(F.col("id").alias("story"), F.posexplode("kids").alias("at", "id"))
    return kids.join(parsed.where("type = 'comment'").select("id", F.col("by").alias("author"), T.tags_off(F.coalesce("text", F.lit(""))).alias("text")), "id").select("story", F.col("id").alias("comment"), "at", "author", "text")


def recent_hits(answers: DataFrame, now_s: int, days: int = 365) -> DataFrame:
    """node, at and the raw hits of searches, those of the last year."""
    r = _items(answers, HITS, "answer.hits")
    return r.where(F.col("r.created_at_i") > now_s - days * 86400)
