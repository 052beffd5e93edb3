"""Chat exports: lines to messages, senders, system lines and placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a line of an export begins, and texts that stand for attachments.
STAMP = r"^\[?\s*(\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4},?\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap]\.?[Mm]\.?)?)\s*[\]]?\s*(?:-\s*)?(.*)$"
PLACEHOLDERS = (
    "<media omitted>", "image omitted", "video omitted", "audio omitted", "sticker omitted", "gif omitted", "document omitted",
    "this message was deleted", "you deleted this message", "missed voice call", "missed video call", "null",
)


def islands(lines: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str) -> DataFrame:
    """Numbers the messages of each key: a line that starts none goes on with the one before.

    Lines before the first message belong to none and are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(starts.cast("int")).over(w)).where(F.col(name) > 0)


def parse_chats(exports: DataFrame, chat: str = "chat", raw: str = "raw") -> DataFrame:
    """chat, sender, sent_at, text, line_no, id of each message of whole exports.

    Lines without a stamp go on with the message before. Messages without a sender (or with one
    of more than 60 characters) are the system's and are left out with their further lines'
    text; placeholders for attachments are left out too.
    """
    clean = F.regexp_replace(F.translate(F.col(raw), "‎‏‪‬﻿", ""), "\r\n?", "\n")
    lines = exports.select(F.col(chat).alias("chat"), F.posexplode(F.split(clean, "\n")).alias("at", "line"))
    lines = lines.select("chat", (F.col("at") + 1).alias("line_no"), F.rtrim("line").alias("line")).where("line <> ''")
    rest = F.trim(F.regexp_extract("line", STAMP, 2))
    sender = F.substring_index(rest, ": ", 1)
    stamped = F.col("line").rlike(STAMP)
    known = stamped & rest.contains(": ") & (F.length(sender) <= 60)
    body = F.trim(F.substring(rest, F.length(sender) + 3, F.length(rest)))
    usable = known & ~F.lower(body).isin(*PLACEHOLDERS)
    # Further lines follow the last message that was kept, so system lines do not break it.
    marked = lines.where(usable | ~stamped).select("chat", "line_no", "line", usable.alias("starts"), F.trim(sender).alias("sender"), F.regexp_extract("line", STAMP, 1).alias("sent_at"), F.when(usable, body).otherwise(F.trim("line")).alias("part"))
    numbered = islands(marked, ["chat"], ["line_no"], F.col("starts"), "message")
    joined = numbered.groupBy("chat", "message").agg(
        F.min_by("sender", "line_no").alias("sender"),
        F.min_by("sent_at", "line_no").alias("sent_at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "\n").alias("text"),
        F.min("line_no").alias("line_no"),
    )
    return joined.select("chat", "sender", "sent_at", "text", "line_no", F.sha2(F.concat_ws("|", "chat", "sent_at", "sender", "text"), 256).alias("id"))
