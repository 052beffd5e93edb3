"""Removal of byte strings that an earlier document holds, by suffix sorting of shards.

A window's shard comes from its smallest inner hash (its minimizer), so equal windows of
different documents meet. Neighbouring windows of one minimizer form a region. A window holds
half of what a window has beside its minimizer before that or behind it, so first only hashes
of minimizers with so much before and behind them are shuffled: a region of which no other
document has any stays. Strings as short as a minimizer recur by chance, the more the larger
the input; these do not. The bytes of the other regions go to their shards, where equal regions
are found by comparing them, and the suffixes of one copy of each content are sorted by
induction (``suffix_sort``); suffixes with a common prefix of a window's length are equal
windows. Hashes only decide what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.postings import BASE, LOW, PACKED, Packer, bucket_of, buckets_for, by_bucket, by_part, from_parts, mix, packed_column, text_chunks, to_parts, unpack
from siltwork.llm.shared import Steps, expand, squeeze
from siltwork.llm.suffix_sort import Scratch, common_prefixes, suffix_order

WINDOW = 50
INNER = 16
SHARD_BYTES = 4_000_000
FLUSH_BYTES = 8_000_000
BLOCK_BYTES = 32_000
SHARDS = "bucket int, rows binary, docs binary, starts binary, sizes binary, keys binary, bytes binary"
PLACES = "part int, owner binary, first binary, last binary"

_MIXERS = np.array([BASE, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def _hashed(eight: np.ndarray, start: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the ``size`` (8 or more) bytes from each place on, out of the eight bytes from each place on."""
    out = mix(eight[start] + np.uint64(seed))
    for done in [*range(8, size - 8, 8), size - 8]:
        out = mix(out * np.uint64(BASE) + eight[start + done])
    return out


def regions(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Regions of a few texts, and the keys by which they are asked for.

    Per region its text, first and last window there, and minimizer (the least of many hashes,
    so it is mixed again to fall evenly into buckets). Per key its value and its region. A key
    is of the minimizer's leftmost place in some window with half of the window's other bytes
    before or behind it, so equal windows have a key in common.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    size = int(ends[-1]) if len(ends) else 0
    if size < window:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    joined = b"".join(texts) + bytes(8)
    eight = np.ndarray(size + 1, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    inner = eight[: size - INNER + 1] * _MIXERS[0]
    inner += eight[INNER - 8 : size - 7] * _MIXERS[1]
    inner ^= inner >> np.uint64(32)
    inner *= _MIXERS[2]
    least = inner & _HIGH
    least |= np.arange(len(least), dtype=np.uint64)
    least = sliding_least(least, window - INNER + 1) & _LOW
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    place, last = least[first].astype(np.int64), np.r_[first[1:], len(least)] - 1
    text = np.searchsorted(ends, place, side="right")
    begins = (ends - sizes)[text]
    first, last = np.maximum(first, begins), np.minimum(last, ends[text] - window)
    inside = first <= last
    place, first, last, text, begins = place[inside], first[inside], last[inside], text[inside], begins[inside]
    half = (window - INNER) // 2
    before, behind = np.flatnonzero(place - half >= first), np.flatnonzero(place + INNER + half <= last + window)
    keys = np.r_[_hashed(eight, place[before] - half, INNER + half, 1), _hashed(eight, place[behind], INNER + half, 2)]
    value = mix(inner[place])
    new = np.ones(len(place), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1]) | (first[1:] != last[:-1] + 1)
    region, opens = np.cumsum(new) - 1, np.flatnonzero(new)
    closes = np.r_[opens[1:], len(place)][: len(opens)] - 1
    return text[opens], first[opens] - begins[opens], last[closes] - begins[opens], value[opens], keys, region[np.r_[before, behind]]


def _distinct(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, where each one's keys begin (with the end), and its distinct keys."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    owner, keys = owner[fresh], keys[fresh]
    cut = np.flatnonzero(np.r_[len(owner) > 0, owner[1:] != owner[:-1]])
    return owner[cut], np.r_[cut, len(owner)], keys


def _shared(table: pa.Table, buckets: np.ndarray) -> pa.Table:
    """Keys that several documents hold, on their way back to these."""
    rows, _, keys, run = unpack(table)
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    row = rows[run[order]]
    low, high = np.minimum.reduceat(row, begins), np.maximum.reduceat(row, begins)
    several = np.repeat(low != high, np.diff(np.r_[begins, len(order)]))
    keys = keys[order][several]
    return to_parts(buckets, row[several], low=(keys & _LOW).astype("<u4"), high=(keys >> np.uint64(32)).astype("<u2"))


def _asked(table: pa.Table) -> pa.Table:
    rows, begins, values = from_parts(table, low="<u4", high="<u2")
    return pa.table({"row": pa.array(rows), **{name: packed_column(v, begins) for name, v in values.items()}})


def _placed(table: pa.Table) -> pa.Table:
    rows, begins, values = from_parts(table, first="<u4", last="<u4")
    return pa.table({"row": pa.array(rows), **{name: packed_column(v, begins) for name, v in values.items()}})


class Dealer:
    """Packs regions' bytes by shard; of those with equal bytes in a task only the earliest go on.

    A later document's region equals an earlier one's, so it goes as a whole at once. A very
    common passage thus sends one copy per task and not one per document. What is already
    decided travels through a shard of its document's.
    """

    def __init__(self, shards: np.ndarray, window: int):
        self.shards, self.window = shards, window
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        self.held: dict[bytes, int] = {}
        self.contents: list[int] = []
        self.known: list[tuple[np.ndarray, ...]] = []

    def add(self, texts: list[bytes], text: np.ndarray, first: np.ndarray, last: np.ndarray, minimizer: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, end = self.held, last + self.window
        self.contents += [held.setdefault(texts[t][a:b], len(held)) for t, a, b in zip(text.tolist(), first.tolist(), end.tolist())]
        shard = self.shards[bucket_of(minimizer, len(self.shards))]
        self.known.append((rows[text], docs[text], first, end - first, shard, minimizer & _LOW))
        self.size += sum(map(len, texts))
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.contents:
            self._clear()
            return
        content, pieces = np.array(self.contents), list(self.held)
        row, doc, start, size, shard, key = (np.concatenate(k) for k in zip(*self.known))
        earliest = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(earliest, content, doc)
        gone = doc > earliest[content]
        shard = np.where(gone, self.shards[bucket_of(mix(row.astype(np.uint64)), len(self.shards))], shard)
        size, key = np.where(gone, -size, size), np.where(gone, 0, key)
        order = np.argsort(shard, kind="stable")
        shard, stays = shard[order], ~gone[order]
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        columns = [pa.array(shard[cut[:-1]], pa.int32())]
        for values, kind in ((row, np.int64), (doc, np.int64), (start, "<u4"), (size, "<i4"), (key, "<u4")):
            values = values[order].astype(kind)
            columns.append(pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()))
        sent = [pieces[c] for c in content[order][stays].tolist()]
        cut = np.r_[0, np.cumsum(stays)][cut].tolist()
        columns.append(pa.array([b"".join(sent[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()))
        self._clear()
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "docs", "starts", "sizes", "keys", "bytes"])


def first_copies(table: pa.Table) -> tuple[tuple[np.ndarray, ...], list[bytes], np.ndarray]:
    """Regions to be sorted (rows, docs, starts) with their bytes, and those decided: row, start, size.

    Of equal regions the earliest document's stays and those of later documents go. What stays
    need be sorted only where one minimizer has several contents, of several documents.
    """
    held: dict[bytes, int] = {}
    contents: list[int] = []
    known: list[list[np.ndarray]] = [[], [], [], [], []]
    for r in table.to_pylist():
        for values, c, kind in zip(known, ("rows", "docs", "starts", "sizes", "keys"), (np.int64, np.int64, "<u4", "<i4", "<u4")):
            values.append(np.frombuffer(r[c], kind))
        size, body = known[3][-1], r["bytes"]
        end = np.cumsum(size[size > 0])
        contents += [held.setdefault(body[a:b], len(held)) for a, b in zip([0, *end[:-1].tolist()], end.tolist())]
    row, doc, start, size, key = (np.concatenate(k).astype(np.int64) for k in known)
    decided = np.stack([row, start, -size], 1)[size < 0]
    row, doc, start, size, key = (v[size > 0] for v in (row, doc, start, size, key))
    content, pieces = np.array(contents, np.int64), list(held)
    earliest, minimizer = np.full(len(pieces), np.iinfo(np.int64).max), np.zeros(len(pieces), np.int64)
    np.minimum.at(earliest, content, doc)
    minimizer[content] = key
    order = np.argsort(minimizer, kind="stable")
    opens = np.flatnonzero(np.r_[len(order) > 0, minimizer[order][1:] != minimizer[order][:-1]])
    several = np.zeros(len(pieces), bool)
    if len(opens):
        differ = np.minimum.reduceat(earliest[order], opens) != np.maximum.reduceat(earliest[order], opens)
        several[order] = np.repeat(differ, np.diff(np.r_[opens, len(order)]))
    later = doc > earliest[content]
    sort = np.flatnonzero(~later & several[content])
    decided = np.concatenate([decided, np.stack([row, start, size], 1)[later]])
    return (row[sort], doc[sort], start[sort]), [pieces[c] for c in content[sort].tolist()], decided


def sort_shard(table: pa.Table, window: int, buckets: np.ndarray) -> pa.Table:
    """Windows of a shard that start in an earlier document too: per row, first and last places of runs."""
    (rows, docs, starts), pieces, decided = first_copies(table)
    sizes = np.array([len(p) for p in pieces], np.int64)
    row, place = _repeated_places(rows, docs, starts, sizes, pieces, window) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    last = place[np.r_[begins[1:], len(place)] - 1] if len(begins) else begins
    first, owner = np.r_[place[begins], decided[:, 1]], np.r_[row[begins], decided[:, 0]]
    last = np.r_[last, decided[:, 1] + decided[:, 2] - window]
    return to_parts(buckets, owner, first=first.astype("<u4"), last=last.astype("<u4"))


def _repeated_places(rows: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the windows that a document with a smaller id has too."""
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(sizes)
    with Scratch() as scratch:
        text = scratch.array(total + 1, np.uint16)
        owner = scratch.array(total, np.int32)
        text[:] = 1
        text[total] = 0
        owner[:] = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside = np.ones(total, bool)
        inside[begins + sizes] = False
        text[:total][inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 2
        order = suffix_order(text, 258, window, scratch)[1:]
        left = begins[owner[order]] + sizes[owner[order]] - order
        order = order[left >= window]
        same = common_prefixes(text, order, window)
        source = owner[order]
        doc, row, place = docs[source], rows[source], starts[source] + order - begins[source]
        del text, owner
    group = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.r_[group, len(doc)])) if len(doc) else doc
    return row[doc > first], place[doc > first]


def remove_earlier(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept: UTF-8 bytes without strings of earlier documents.

    Every byte covered by a ``window``-byte string that also starts in a row with a smaller
    integer id goes. Null and empty texts have no bytes; texts shorter than a window stay
    whole. Rows of one id take nothing from each other; a row with a null id stays whole and
    takes nothing from others. ``kept`` can break a character, so it is binary. Other columns
    are ignored. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    given = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch):
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc"), pa.array([len(t) for t in texts], pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary())], names=["row", "doc", "n_bytes", "text"])

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for start, texts in text_chunks(batch, most=BLOCK_BYTES, read=expand):
                text, _, _, _, keys, region = regions(texts, window)
                owner, begins, keys = _distinct(text[region], keys)
                for i, a, b in zip(owner.tolist(), begins[:-1].tolist(), begins[1:].tolist()):
                    yield from packer.add(ids[start + i], keys[a:b])
        yield from packer.flush()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of regions of which another document has a key too."""
        dealer = Dealer(shards, window)
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            for start, texts in text_chunks(batch, most=BLOCK_BYTES, read=expand):
                text, first, last, minimizer, keys, region = regions(texts, window)
                stop = start + len(texts)
                asked = np.frombuffer(b"".join(low[start:stop]), "<u4").astype(np.uint64) | np.frombuffer(b"".join(high[start:stop]), "<u2").astype(np.uint64) << np.uint64(32)
                counts = [len(k) // 4 for k in low[start:stop]]
                # A document's number beside the key's 48 bits: a block has fewer documents than 16 bits tell apart.
                asked = np.sort(asked | np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), counts))
                own = keys & LOW | text[region].astype(np.uint64) << np.uint64(48)
                at = np.searchsorted(asked, own)
                open_ = np.zeros(len(text), bool)
                open_[region[asked[np.minimum(at, len(asked) - 1)] == own]] = True
                yield from dealer.add(texts, text[open_], first[open_], last[open_], minimizer[open_], rows[start:stop], ids[start:stop])
        yield from dealer.flush()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch, read=expand):
                rows = batch.slice(start, len(texts))
                removed, spans, kept = [], [], []
                for body, first, last in zip(texts, rows.column("first").to_pylist(), rows.column("last").to_pylist()):
                    if not first:
                        removed.append(0)
                        spans.append(0)
                        kept.append(body)
                        continue
                    edge = np.zeros(len(body) + 1, np.int32)
                    np.add.at(edge, np.frombuffer(first, "<u4"), 1)
                    np.add.at(edge, np.frombuffer(last, "<u4").astype(np.int64) + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    removed.append(int(covered.sum()))
                    spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
                    kept.append(np.frombuffer(body, np.uint8)[~covered].tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = steps.keep(given.mapInArrow(store, "row long, doc long, n_bytes long, text binary"), "texts")
    buckets, shards = buckets_for(texts), buckets_for(texts, each=SHARD_BYTES)
    n = len(buckets)
    able = texts.where(F.col("doc").isNotNull() & (F.col("n_bytes") >= window)).select("row", "doc", "text")
    announced = by_bucket(able.mapInArrow(announce, PACKED), n).applyInArrow(lambda t: _shared(t, buckets), "part int, owner binary, low binary, high binary")
    asked = by_part(announced, n).applyInArrow(_asked, "row long, low binary, high binary").withColumnRenamed("row", "doc")
    opened = steps.keep(able.join(asked, "doc").select("row", "doc", "text", "low", "high"), "opened")
    sorted_shards = by_bucket(opened.mapInArrow(deal, SHARDS), len(shards)).applyInArrow(lambda t: sort_shard(t, window, buckets), PLACES)
    places = steps.keep(by_part(sorted_shards, n).applyInArrow(_placed, "row long, first binary, last binary"), "places")
    steps.drop("opened")
    final = texts.join(places, "row", "left").select("doc", "n_bytes", "text", "first", "last")
    return final.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc", key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings of earlier documents removed from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_earlier(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
