"""Readers of files that people drop: chat exports, mails, forms, labels, profiles and theses."""

from __future__ import annotations

import email
import email.policy
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from siltwork.functions import text as T

#: Words that a form's headers contain, in the order in which they are tried.
FORM_FIELDS = {
    "name": ("company", "startup", "name"), "pitch": ("description", "pitch", "what", "summary", "about"), "site": ("website", "url"),
    "stage": ("stage",), "raising": ("raising", "round"), "team": ("founder", "team"), "contact": ("founder", "contact", "email"),
}
#: Headers of imported profiles, and how their lists are split.
PROFILE_FIELDS = {
    "name": ("name", "Name", "full_name", "Full Name"), "headline": ("headline", "Headline", "title", "Title"), "location": ("location", "Location"), "about": ("about", "About", "bio", "Bio", "summary", "Summary"),
    "profile_url": ("profileUrl", "profile_url", "linkedin_url", "LinkedIn URL", "url"), "company": ("companyName", "company", "Company", "company_name"), "company_url": ("companyUrl", "company_url"),
    "website": ("website", "Website", "domain", "Domain"), "experience": ("experience", "Experience"), "education": ("education", "Education"), "skills": ("skills", "Skills"), "posts": ("posts", "Posts", "activity"),
}
LISTS = {"experience": "\n|;", "education": "\n|;", "skills": ",|;", "posts": "\n---\n|;"}
THESIS = "id string, name string, prose string, founder_voice string, exclude array<string>, must_have array<string>, hard_signals array<string>, weights map<string,double>, report_fields array<struct<key:string,label:string,hint:string,only_if:string>>, ord int"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1))


def folder_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def chat_exports(spark: SparkSession, folder: str) -> DataFrame:
    """chat, raw of exports: plain texts, and of archives the first text inside; one without is left out."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.endswith(".txt")]
                        content = z.read(names[0]) if names else None
                out.append(None if content is None else content.decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "raw"])

    found = _files(spark, folder, "*.{txt,zip}").mapInArrow(unpacked, "path string, raw string").where("raw IS NOT NULL")
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
    return found.select(F.trim(F.replace(F.replace(stem, F.lit("WhatsApp Chat with "), F.lit("")), F.lit("_chat"), F.lit(""))).alias("chat"), "raw")


def plain_body(content: bytes) -> tuple[str, str, str, str]:
    """Subject, sender, date and the first plain text of a mail."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    part = message.get_body(("plain",)) if message.is_multipart() else message
    try:
        body = part.get_content() if part is not None else ""
    except (LookupError, KeyError, ValueError):
        body = part.get_payload(decode=True) or b""
    body = body if isinstance(body, str) else bytes(body).decode("utf-8", errors="replace")
    return str(message.get("subject") or ""), str(message.get("from") or ""), str(message.get("date") or ""), body


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """Records of dropped mails: what stands above quoted history and signatures.

    The file's name is the identity, so a mail dropped again is the same lead; its folder is the
    node. Without a subject the file's name stands for it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(zip(*[plain_body(c) for c in batch.column("content").to_pylist()])) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array(list(p), pa.string()) for p in parts]], names=["path", "subject", "sender", "date", "body"])

    m = _files(spark, folder, "*.eml").mapInArrow(read, "path string, subject string, sender string, date string, body string")
    name = file_name(F.col("path"))
    title = F.when(F.col("subject") != "", F.col("subject")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return m.select(
        F.lit("inbound").alias("source"),
        F.concat(F.lit("inbound://"), name).alias("source_url"),
        F.concat(title, F.lit("\n\n"), T.mail_body(F.col("body"))).alias("raw_text"),
        title.alias("title"),
        F.col("sender").alias("author"),
        folder_name(F.col("path")).alias("node"),
        F.when(F.col("date") != "", F.col("date")).alias("posted_at"),
    )


def loosely(columns: Sequence[str], words: Sequence[str]) -> Column:
    """The first filled value of the columns whose headers contain a word, words first, then columns."""
    fitting = [F.trim(F.col(f"`{c}`")) for word in words for c in columns if word in c.strip().lower()]
    return F.coalesce(*[F.when(c != "", c) for c in fitting]) if fitting else F.lit(None).cast("string")


def forms(rows: DataFrame, name: str) -> DataFrame:
    """Records of an application form's rows; ``line`` is the row's number in the file.

    Headers are matched by the words that they contain. Rows without name and pitch are left out.
    """
    columns = [c for c in rows.columns if c != "line"]
    f = {k: loosely(columns, words) for k, words in FORM_FIELDS.items()}
    title = F.coalesce(f["name"], F.substring(f["pitch"], 1, 80))
    return rows.where(f["name"].isNotNull() | f["pitch"].isNotNull()).select(
        F.lit("inbound").alias("source"),
        F.concat(F.lit(f"inbound://{name}#"), "line").alias("source_url"),
        F.concat_ws("\n\n", *[f[k] for k in ("name", "pitch", "site", "stage", "raising", "team")]).alias("raw_text"),
        title.alias("title"),
        F.coalesce(f["contact"], F.lit("")).alias("author"),
        F.lit(name).alias("node"),
        F.lit(None).cast("string").alias("posted_at"),
    )


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with headers and each row's number in the file (2 for the first), in one task per file."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.withColumn("line", (F.monotonically_increasing_id() + 2).cast("long"))


def label_rows(rows: DataFrame) -> DataFrame:
    """similarity, was_good of labelled rows; 1, y and yes are good, blank labels are left out."""
    label = F.lower(F.trim("label"))
    return rows.where(F.coalesce(label, F.lit("")) != "").select(F.col("similarity").cast("double").alias("similarity"), label.isin("1", "y", "yes").cast("int").alias("was_good"))


def imported_profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of a CSV's rows, and row, error of those that cannot be used.

    The first filled header of each field counts. A row needs a name; a profile's address must be one.
    """
    columns = rows.columns

    def first(names: Sequence[str]) -> Column:
        fitting = [F.trim(F.col(f"`{c}`")) for c in names if c in columns]
        return F.coalesce(*[F.when(c != "", c) for c in fitting], F.lit("")) if fitting else F.lit("")

    picked = rows.select("line", *[first(names).alias(k) for k, names in PROFILE_FIELDS.items()])
    errors = F.array_compact(F.array(
        F.when(F.col("name") == "", "name is required"),
        F.when((F.col("profile_url") != "") & ~F.col("profile_url").rlike("^https?://"), "profile_url must be an address"),
    ))
    checked = picked.withColumn("errors", errors)
    split = {k: F.filter(F.transform(F.split(k, pattern), (lambda x: F.trim(x)) if k == "skills" else (lambda x: x)), lambda x: x != "") for k, pattern in LISTS.items()}
    good = checked.where(F.size("errors") == 0).drop("errors").withColumns(split)
    bad = checked.where(F.size("errors") > 0).select((F.col("line") - 1).alias("row"), F.array_join("errors", "; ").alias("error"))
    return good, bad


def json_profiles(rows: DataFrame, schema: str) -> DataFrame:
    """The object of each JSON text, or the first one of an array."""
    one, many = F.from_json("body", schema), F.from_json("body", f"array<{schema}>")
    return rows.select(F.when(F.ltrim("body").startswith("["), F.get(many, F.lit(0))).otherwise(one).alias("p")).where("p IS NOT NULL").select("p.*")


def theses(spark: SparkSession, folder: str) -> DataFrame:
    """Theses of a folder's JSON files (and YAML ones where a YAML reader is installed), by file name.

    Ids and names are texts even where a file writes numbers. Files are read by Spark; a fund
    has a handful of theses, so they are put in shape on the driver.
    """
    found = []
    files = _files(spark, folder, "*.{json,yaml}").orderBy("path").collect()
    for at, r in enumerate(files):
        if r["path"].endswith(".yaml"):
            import yaml

            raw = yaml.safe_load(bytes(r["content"]))
        else:
            raw = json.loads(bytes(r["content"]))
        fields = [(f.get("key"), f.get("label"), f.get("hint"), f.get("only_if")) for f in raw.get("report_fields", [])]
        lists = [[str(x) for x in raw.get(k, [])] for k in ("exclude", "must_have", "hard_signals")]
        found.append((str(raw["id"]), str(raw.get("name", raw["id"])), raw.get("prose", ""), raw.get("founder_voice", ""), *lists, {k: float(v) for k, v in raw.get("weights", {}).items()}, fields, at))
    return spark.createDataFrame(found, ty.StructType.fromDDL(THESIS))


def topics() -> list[tuple[str, str, list[str]]]:
    """A small built-in table of topics (id, title, keywords) to match profiles with."""
    return [
        ("agents", "Software that acts for its users", ["agent", "automation", "workflow"]),
        ("industry", "Tools for factories and supply chains", ["manufacturing", "supply", "logistics"]),
        ("health", "Care that costs less", ["health", "clinical", "patient"]),
        ("finance", "Plumbing of payments and compliance", ["payments", "compliance", "ledger"]),
    ]
