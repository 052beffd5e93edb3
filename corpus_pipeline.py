"""The corpus pipeline: stages that each call one operator on all that the one before kept.

Each stage is written as Parquet and read again before the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.ngram_join import similar_documents
from siltwork.llm.packing import byte_vocabulary, pack
from siltwork.llm.quality import THRESHOLD, fit, score
from siltwork.llm.shared import Steps, ensure_checkpoint_dir
from siltwork.llm.suffix_dedup import remove_earlier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; rejected ones go.

    Null and empty texts are scored like any other text without words. Equal texts have equal
    scores, so repeated rows stay or go together; null ids are kept apart from nothing. Other
    columns than those of ``documents`` are dropped. An empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs.select(*COLUMNS), fit(docs, labels), out="__score").where(F.col("__score") >= THRESHOLD).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates.

    Rows of one id stay or go together, so repeated rows of a kept id stay. Null and empty
    texts are linked with nothing and stay, and so does a row without an id unless it is a near
    copy of one that has one. Other columns are dropped. An empty table stays empty.
    """
    found = similar_documents(docs.select("doc_id", "text"))
    first = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of earlier documents; ``n_chars`` is counted anew.

    Characters cut at a seam go, and so do documents of which nothing is left; texts that were
    null or empty stay, as empty. Of rows with one id, whose texts take nothing from each other,
    each keeps its text, with the smallest lang and source of that id. A row without an id stays
    whole. Other columns are dropped. An empty table stays empty.
    """
    kept = remove_earlier(docs.select("doc_id", "text")).where("n_removed = 0 OR octet_length(kept) > 0")
    text = F.col("kept").cast("string")
    clean = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    rest = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    joined = kept.select("doc_id", clean.alias("text")).join(rest, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024, by document.

    Null and empty texts are a single end id. Repeated rows and rows without an id are packed
    like any other. Other columns are dropped. An empty table has no pieces.
    """
    pieces = pack(docs, ["doc_id"], *byte_vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each_group),
    ("repeated_strings", without_repeats),
    ("packing", packed),
]

#: Hashing in windows, a trained score and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is written, and deleted once the next is."""
    steps = Steps(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = steps.keep(stage(spark, docs, sf_dir), name)
        if before:
            steps.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
