"""Names of all documents against Python's re, whose words know letters of every script."""

import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.plans import catalogue

DATA = "/root/testdata/sf0.001"
NOISE = re.compile(r"\b(inc|llc|ltd|gmbh|bv|ab|oy|corp|co|the|a|an)\b\.?")


def wanted(text):
    low = text[:40].lower()
    short = text if len(text) <= 21 else f"{text[:9]}...{text[-9:]}"
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", low)), re.sub("[^a-z0-9]+", "", NOISE.sub("", low)), short


def test_all_documents_have_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.slug, r.name, r.short) for r in catalogue.QUERIES["normal_names"](spark, DATA).collect()}
    assert any(not r.text[:40].isascii() for r in docs)
    assert found == {r.doc_id: wanted(r.text) for r in docs}


def test_agrees_with_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    known = con.execute(f"SELECT doc_id, slug, name, short FROM ({catalogue.ORACLES['normal_names']})").fetchall()
    found = {tuple(r) for r in catalogue.QUERIES["normal_names"](spark, DATA).select("doc_id", "slug", "name", "short").collect()}
    assert known and set(known) == found


def test_noise_words_end_at_letters_of_any_script(spark):
    names = ["ça va", "a ça", "Él co", "coéquipier", "Müller Co. GmbH", "añ an", "ä.a.ä", "the_a a", "Ångström AB", "aé a", "日本 co 日本co", unicodedata.normalize("NFD", "é a")]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = [r.n for r in rows.select(T.normal_name(F.col("name")).alias("n")).collect()]
    assert found == [wanted(n)[1] for n in names]
