"""Chat formatting with Spark expressions only.

Template: ``[INST]role[/INST]text<s>text...</s>`` for each run of adjacent turns of
one role. Inside texts and roles a backslash is doubled and a control string gets a
backslash after its first character, so a text never contains a control string and
reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "<s>", "</s>"
BLOCKS = "array<struct<role:string,texts:array<string>>>"
SPANS = "struct<at:int,spans:array<struct<start:int,length:int>>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE, NEXT, END):
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """A doubled backslash becomes one; a single one stands only inside a control string and goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _blocks(turns: Column) -> Column:
    """Sorted turns with adjacent turns of one role put together."""

    def add(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(
            last["role"] == turn["role"],
            F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined),
        ).otherwise(F.array_append(done, new)).cast(BLOCKS)

    return F.aggregate(turns, F.array().cast(BLOCKS), add)


def _spans(blocks: Column, role: str) -> Column:
    """Where in the formatted text the escaped texts of a role stand: from 0, in code points."""

    def text(acc: Column, value: Column, taken: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), F.length(value).alias("length"))
        return F.struct(
            (acc["at"] + F.length(value) + len(NEXT)).alias("at"),
            F.when(taken, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        ).cast(SPANS)

    def block(acc: Column, b: Column) -> Column:
        head = F.struct((acc["at"] + len(OPEN) + F.length(b["role"]) + len(CLOSE)).alias("at"), acc["spans"].alias("spans")).cast(SPANS)
        after = F.aggregate(b["texts"], head, lambda a, t: text(a, t, b["role"] == role))
        return F.struct((after["at"] - len(NEXT) + len(END)).alias("at"), after["spans"].alias("spans")).cast(SPANS)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(SPANS)
    return F.aggregate(blocks, start, block)["spans"]


def format_chat(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: key, ``formatted`` and ``loss_spans`` (of the ``learn`` role's texts).

    Turns go by turn number, ties by role and text, a null number first. Null texts and roles
    are empty. Repeated rows are turns of their own. A null key is a conversation. Other
    columns are ignored. An empty table gives an empty result.
    """
    turns = rows.select(
        F.col(f"`{key}`").alias("__key"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            escape(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("text"),
        ).alias("__turn"),
    )
    blocks = turns.groupBy("__key").agg(F.sort_array(F.collect_list("__turn")).alias("turns")).select("__key", _blocks(F.col("turns")).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(CLOSE), F.array_join(b["texts"], NEXT), F.lit(END)))
    return blocks.select(
        F.col("__key").alias(key),
        F.array_join(shown, "").alias("formatted"),
        _spans(F.col("blocks"), learn).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """Reads a formatted conversation back: array of (role, text) per original turn."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, CLOSE)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.split(F.substring(block, at + len(CLOSE), F.length(block)), NEXT)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    chats = format_chat(rows.unionByName(probe))
    read = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>') AS safe,
           replace(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>') AS safe_role
    FROM rows
), placed AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, safe_role, safe) = role, false) AS joins,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, safe_role, safe) AS place
    FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + CASE WHEN joins THEN 3 ELSE 17 + length(safe_role) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
