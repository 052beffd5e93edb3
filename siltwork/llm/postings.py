"""Compact shuffles of hashed keys: packed rows per bucket instead of a row per key.

Words are hashed eight bytes at a time, each mixed into the state before, and words of over 64
bytes by keyed BLAKE2b. A window's hash joins those of its halves, again and again, by a
product, a sum and a mix, so no pair of words or windows collides by its structure. Keys travel
as their low 48 bits; the bucket comes from the high 16.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64((1 << 48) - 1)
CHUNK_BYTES = 500_000
FLUSH_KEYS = 400_000
LEAST_BUCKETS = 24
BUCKET_BYTES = 16_000_000
WORD_KEY, LONG_WORD = b"siltwork words", 64
PACKED = "bucket int, docs binary, counts binary, extra binary, keys binary, more binary"

_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more than texts).

    Words are runs without ASCII white space; ``fold`` takes A-Z as a-z.
    """
    joined = b"\n".join(texts) + b"\n" + bytes(8)
    joined = joined.lower() if fold else joined
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(joined, np.uint8, len(joined) - 8)], prepend=True))
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    hashes = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    for done in range(0, LONG_WORD, 8):
        at = np.flatnonzero(size > done)
        if not len(at):
            break
        lane = eight[start[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
        hashes[at] = mix(hashes[at] * np.uint64(BASE) + lane)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(joined[start[i] : end[i]], digest_size=8, key=WORD_KEY).digest(), "little")
    return hashes, np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))


def word_counts(texts: list[bytes]) -> np.ndarray:
    """How many words each text has."""
    space = _SPACE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    return np.diff(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts])))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values, joined from runs of 1, 2, 4, ... values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = min(len(a), len(b))
        return mix(a[:size] * np.uint64(BASE) + b[:size])

    out, done, power, size = None, 0, values, 1
    while True:
        if width & size:
            out, done = power if out is None else join(out, power[done:]), done + size
        if done == width:
            return mix(out[:n] + np.uint64(width))
        power, size = join(power, power[size:]), 2 * size


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES, read: Callable[[bytes], bytes] = bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of about so many bytes; null is the empty text."""
    values, texts, first, size = batch.column(column).cast(pa.binary()), [], 0, 0
    for i in range(batch.num_rows):
        value = values[i].as_py()
        text = read(value) if value else b""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def buckets_for(texts: DataFrame, size: str = "n_bytes", each: int = BUCKET_BYTES) -> np.ndarray:
    """The numbers of the buckets, as many as the bytes of all texts (a column) ask for.

    A bucket is one task's group, so their count grows with the input and each stays of one
    size. The numbers are such that each falls into a partition of its own.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(size)).first()[0] or 0
    return even_numbers(spark, max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each)))


def even_numbers(spark: SparkSession, n: int) -> np.ndarray:
    """So many integers of which each falls into a partition of its own."""
    number = F.col("id").cast("int")
    found = spark.range(40 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("part")).agg(F.min(number).alias("number")).collect()
    return np.array(sorted(r["number"] for r in found), np.int32)


def short(values: np.ndarray) -> bytes:
    """The low 48 bits of each value: all low 32 bits, then all others."""
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((values & LOW) >> np.uint64(32)).astype("<u2").tobytes()


def long(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps_of(values: np.ndarray) -> bytes:
    """64-bit numbers, ascending or nearly so, as the planes of their differences."""
    return planes(np.diff(values.astype(np.int64), prepend=np.int64(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.int64), dtype=np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many buckets each key falls into, by its high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 65536 else np.uint32)


class Packer:
    """Collects keys of documents, each with another 48-bit value if wanted, and packs them by bucket."""

    def __init__(self, buckets: np.ndarray):
        self.buckets, self.size = buckets, 0
        self.keys: list[np.ndarray] = []
        self.more: list[np.ndarray] = []
        self.docs: list[int] = []
        self.extra: list[int] = []

    def add(self, doc: int, keys: np.ndarray, extra: int = 0, more: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.keys.append(keys)
            if more is not None:
                self.more.append(more)
            self.docs.append(doc)
            self.extra.append(extra)
            self.size += len(keys)
            if self.size >= FLUSH_KEYS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys = np.concatenate(self.keys)
        owner = np.repeat(np.arange(len(self.docs)), [len(k) for k in self.keys])
        docs, extra = np.array(self.docs, np.int64), np.array(self.extra, np.int32)
        bucket = bucket_of(keys, len(self.buckets))
        order = np.argsort(bucket, kind="stable")
        keys, owner, bucket = keys[order], owner[order], bucket[order]
        more = np.concatenate(self.more)[order] if self.more else None
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1) if len(bucket) else [])
        rows: list[list] = [[], [], [], [], [], []]
        for a, b in zip(cut[:-1], cut[1:]):
            begins = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            who = owner[a:b][begins]
            for column, value in zip(rows, (int(self.buckets[bucket[a]]), steps_of(docs[who]), planes(np.diff(begins, append=b - a).astype(np.int32)), planes(extra[who]), short(keys[a:b]), b"" if more is None else short(more[a:b]))):
                column.append(value)
        self.keys, self.more, self.docs, self.extra, self.size = [], [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "docs", "counts", "extra", "keys", "more"])


def unpack(table: pa.Table, more: bool = False) -> tuple[np.ndarray, ...]:
    """Per document run: docs, extra; per key: key (48 bits), index of its run, and the other value if wanted."""
    docs, counts, extra, keys, values = [], [], [], [], []
    for batch in table.to_batches():
        for r in range(batch.num_rows):
            docs.append(from_steps(batch.column("docs")[r].as_py()))
            counts.append(from_planes(batch.column("counts")[r].as_py(), np.int32))
            extra.append(from_planes(batch.column("extra")[r].as_py(), np.int32))
            keys.append(long(batch.column("keys")[r].as_py()))
            if more:
                values.append(long(batch.column("more")[r].as_py()))
    counts = np.concatenate(counts)
    found = (np.concatenate(docs), np.concatenate(extra), np.concatenate(keys), np.repeat(np.arange(len(counts)), counts))
    return (*found, np.concatenate(values)) if more else found


def by_bucket(packed: DataFrame, buckets: int):
    """Groups of the buckets, one to a task."""
    return packed.repartition(buckets, "bucket").groupBy("bucket")


def sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and where each run of equal keys begins (with the end)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate([np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1))), [len(keys)]])


def to_parts(buckets: np.ndarray, owner: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Values on their way back to their owners: one row per part of the owners, as many parts as buckets."""
    part = bucket_of(mix(owner.astype(np.uint64)), len(buckets))
    order = np.argsort(part, kind="stable")
    part, given = part[order], {"owner": owner[order], **{name: values[order] for name, values in columns.items()}}
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    packed = {name: pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for name, values in given.items()}
    return pa.table({"part": pa.array(buckets[part[cut[:-1]]], pa.int32()), **packed})


def from_parts(table: pa.Table, **kinds) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Owners of a part, where each one's values begin (with the end), and all values in this order."""
    read = {name: np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(name)]) for name, kind in {"owner": np.int64, **kinds}.items()}
    owner = read.pop("owner")
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[begins], np.r_[begins, len(owner)], {name: values[order] for name, values in read.items()}


def by_part(replies: DataFrame, buckets: int):
    """Groups of the parts, one to a task."""
    return replies.repartition(buckets, "part").groupBy("part")


def packed_column(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])], pa.binary())
