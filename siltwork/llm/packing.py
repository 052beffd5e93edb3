"""Packing by concatenation and cutting at fixed windows, in two passes.

Pass one tokenizes once and stores each document's ids with its place inside its
partition. Prefix sums over the partition totals (one small row per partition) give
each partition its global offset; pass two cuts every document at multiples of the
window. Only the last sequence can be short.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.llm.shared import Steps

WINDOW = 1024
END_ID = 0
MEMO_PIECES = 300_000
CHUNK_CHARS = 4_000_000
TOKENS = "__part integer, __start long, __n long, __ids binary"
MOST_BROADCAST = 1_000_000
PIECES = "start long, length long, ids_crc32 long, sequence_id long, offset long"
RESERVED = ("doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "__part", "__start", "__n", "__ids", "__text")

#: A single space before visible text always begins a new word of the byte-level pattern,
#: so texts cut there encode piece by piece to the same ids.
_CUT = re.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes are their own
    letters, all others, in order, those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of a byte-level vocabulary file by bytes, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    letters = byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in raw["model"]["vocab"].items() if token not in special}, special


class ByteEncoder:
    """Ids of the byte-level vocabulary; remembers a bounded number of pieces.

    Its merges are numbered in their order, so an id is also a merge's rank.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, self.special = vocabulary(path)
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def _segment(self, text: str) -> bytes:
        pieces = _CUT.split(text)
        memo, first = self.memo, self._ids(pieces[0])
        if len(memo) > MEMO_PIECES:
            memo.clear()
        try:
            return first + b"".join([memo[p] for p in pieces[1:]])
        except KeyError:
            for p in pieces[1:]:
                if p not in memo:
                    memo[p] = self._ids(f" {p}")
            return first + b"".join([memo[p] for p in pieces[1:]])

    def encode(self, text: str) -> bytes:
        parts = self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._segment(p) for i, p in enumerate(parts))


def tokenize(docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """The ``keep`` columns, ``__ids`` (packed unsigned 32-bit, with the end id) and each row's
    place in its partition. A kept column named like one of the pieces' comes as ``kept_...``.

    A null text is empty and has the end id only. The partition number and the order inside it
    are those of the task that ran, so store the result before its columns are read twice.
    """
    kept = [F.col(f"`{c}`").alias(f"kept_{c}" if c in RESERVED else c) for c in keep]
    given = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("__text"))
    schema = given.drop("__text").schema
    names = list(schema.names)
    for field in TOKENS.split(", "):
        schema = schema.add(*field.split(" "))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path, pattern)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, done = batch.column("__text"), 0
            while done < batch.num_rows:
                ids, starts, sizes, seen = [], [], [], 0
                while done + len(ids) < batch.num_rows and seen < CHUNK_CHARS:
                    value = texts[done + len(ids)].as_py() or ""
                    seen += len(value) + 1
                    ids.append(encoder.encode(value) + last)
                    starts.append(at)
                    sizes.append(len(ids[-1]) // 4)
                    at += sizes[-1]
                rows = batch.slice(done, len(ids))
                done += len(ids)
                columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *columns], names=schema.names)

    return given.mapInArrow(run, schema)


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """__part, __base: tokens in all partitions before it. One row per partition goes to one task."""
    totals = tokens.groupBy("__part").agg(F.sum("__n").alias("total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__base"))


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of a stored result of ``tokenize``: the kept columns, then start, length,
    ids_crc32, sequence_id, offset and doc_tokens. Each id lies in exactly one piece.

    The offsets have a row of 12 bytes per partition; up to MOST_BROADCAST of them are sent to
    all tasks, more are joined.
    """
    kept = [c for c in tokens.columns if not c.startswith("__")]
    offsets = partition_offsets(tokens)
    few = tokens.agg(F.max("__part")).first()[0] or 0
    placed = tokens.join(F.broadcast(offsets) if few < MOST_BROADCAST else offsets, "__part")
    given = placed.select(*[F.col(f"`{c}`") for c in kept], (F.col("__base") + F.col("__start")).alias("__at"), "__ids")
    schema = given.drop("__at", "__ids").schema.add("doc_tokens", "long")
    for field in PIECES.split(", "):
        schema = schema.add(*field.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in range(6)]
            for i, (at, ids) in enumerate(zip(batch.column("__at").to_pylist(), batch.column("__ids").to_pylist())):
                n, start = len(ids) // 4, 0
                while start < n:
                    offset = (at + start) % window
                    length = min(window - offset, n - start)
                    rows.append(i)
                    for values, value in zip(out, (n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), (at + start) // window, offset)):
                        values.append(value)
                    start += length
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(v, pa.int64()) for v in out]], names=schema.names)

    return given.mapInArrow(run, schema)


def pack(docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Packs all documents into sequences of ``window`` tokens.

    Null and empty texts are a single end id. Repeated rows are packed again. Documents longer
    than a window are cut into several pieces. An empty table has no pieces. Kept columns come
    first, those named like one of the pieces' as ``kept_...``; other columns are ignored. The
    tokens are stored in the shared checkpoint folder between the passes.
    """
    return cut(Steps(docs.sparkSession).keep(tokenize(docs, keep, path, pattern, text), "tokens"), window)


def byte_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 byte-level tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, ["doc_id"], *byte_vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
