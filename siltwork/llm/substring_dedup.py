"""Removal of repeated word windows through difference-cover anchors.

Positions whose residue modulo the period lies in a difference cover are anchors. For any
distance between two places, some offset below the period puts an anchor at both, so two
equal windows share an equal, shorter anchor window that starts at the same offset inside
both. Only anchor windows are hashed and shuffled at first; texts with a repeated anchor then
extend it to the full windows around it.

Hashes only propose. Of full windows with one hash, each is matched with one of them, its
model; neighbouring matches with one model text make a claim, which carries its words to that
text, where they are compared. Where words differ, the window and its model's are both matched
anew, by a hash of their bytes that has nothing to do with the first. A window's equals are
then among the reopened ones, or equal to one of them that is: the first window of a key in a
task stands for all of the task that equal it, and the first of these in the bucket for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.postings import LOW, PACKED, Packer, bucket_of, buckets_for, by_bucket, by_part, from_parts, hash_words, mix, packed_column, sorted_runs, text_chunks, to_parts, unpack, windows, word_counts
from siltwork.llm.shared import Steps, expand, squeeze

WINDOW = 35
#: A perfect difference cover of the residues modulo 21.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)


def anchors(words: int, window: int = WINDOW) -> np.ndarray:
    """Anchor positions of a text of so many words whose anchor window fits."""
    width = window - PERIOD + 1
    if words < window:
        return np.zeros(0, np.int64)
    places = (np.arange(0, words, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places + width <= words]


def _repeats(table: pa.Table, buckets: np.ndarray) -> pa.Table:
    """Keys that stand at two places or more, on their way back to their texts."""
    rows, _, keys, run = unpack(table)
    order, begins = sorted_runs(keys)
    often = np.repeat(np.diff(begins) > 1, np.diff(begins))
    places = order[often]
    pairs = np.unique(np.stack([rows[run[places]], keys[places].astype(np.int64)]), axis=1) if len(places) else np.zeros((2, 0), np.int64)
    return to_parts(buckets, pairs[0], keys=pairs[1])


def _anchored(table: pa.Table) -> pa.Table:
    rows, begins, values = from_parts(table, keys=np.int64)
    return pa.table({"row": pa.array(rows), "anchors": packed_column(values["keys"], begins)})


MATCHES = "row long, places binary, models binary, at binary"


class Matcher:
    """Packs windows by bucket; of those with one key in a task only the first goes to the bucket.

    The others are matched with that first one at once, so a very common window sends one row
    per task and not one per text. Their matches travel through a bucket of their text's.
    """

    def __init__(self, buckets: np.ndarray, most: int = 400_000):
        self.buckets, self.most, self.size = buckets, most, 0
        self.rows: list[int] = []
        self.places: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []

    def add(self, row: int, places: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.places.append(places)
        self.keys.append(keys)
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, place = np.concatenate(self.keys), np.concatenate(self.places).astype(np.uint64)
        row = np.repeat(np.array(self.rows, np.int64), [len(k) for k in self.keys])
        self.rows, self.places, self.keys, self.size = [], [], [], 0
        order, begins = sorted_runs(keys)
        first = order[np.repeat(begins[:-1], np.diff(begins))]
        rest = order != first
        member, model = order[rest], first[rest]
        first = np.sort(order[begins[:-1]])
        packer, cut = Packer(self.buckets), np.flatnonzero(np.diff(row[first], prepend=row[first[:1]] - 1, append=row[first[-1:]] + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            yield from packer.add(int(row[first[a]]), keys[first[a:b]], more=place[first[a:b]])
        yield from packer.flush()
        if len(member):
            member, model = member[np.argsort(member)], model[np.argsort(member)]
            bucket = bucket_of(mix(row[member].astype(np.uint64)), len(self.buckets))
            order = np.argsort(bucket, kind="stable")
            member, model, bucket = member[order], model[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            parts = [(int(self.buckets[bucket[a]]), row[member[a:b]].tobytes(), b"", place[member[a:b]].astype("<u4").tobytes(), row[model[a:b]].tobytes(), place[model[a:b]].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            columns = list(zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "docs", "counts", "extra", "keys", "more"])


def _matched(table: pa.Table, buckets: np.ndarray) -> pa.Table:
    """Each window with the first one of its key, and the matches made before, on their way to their texts."""
    packed = table.filter(pc.greater(pc.binary_length(table.column("counts")), 0))
    found = [[np.zeros(0, np.int64)], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]]
    for batch in table.filter(pc.equal(pc.binary_length(table.column("counts")), 0)).to_batches():
        for name, values, kind in zip(("docs", "extra", "keys", "more"), found, (np.int64, "<u4", np.int64, "<u4")):
            values += [np.frombuffer(v.as_py(), kind) for v in batch.column(name)]
    if packed.num_rows:
        rows, _, keys, run, place = unpack(packed, more=True)
        row, place = rows[run], place.astype("<u4")
        order = np.lexsort((place, row, keys))
        begins = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        first = order[np.repeat(begins, np.diff(np.r_[begins, len(order)]))]
        rest = order != first
        for values, more in zip(found, (row[order[rest]], place[order[rest]], row[first[rest]], place[first[rest]])):
            values.append(more)
    row, place, model, at = (np.concatenate(v) for v in found)
    return to_parts(buckets, row, places=place, models=model, at=at)


def _listed(table: pa.Table) -> pa.Table:
    rows, begins, values = from_parts(table, places="<u4", models=np.int64, at="<u4")
    return pa.table({"row": pa.array(rows), **{name: packed_column(v, begins) for name, v in values.items()}})


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Claims: runs of windows whose models are a run of one text, with their words."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for row, text, *matches in zip(*[batch.column(c) for c in ("row", "text", "places", "at", "models")]):
            place, at, model = (np.frombuffer(m.as_py(), kind).astype(np.int64) for m, kind in zip(matches, ("<u4", "<u4", np.int64)))
            order = np.argsort(place, kind="stable")
            place, model, at = place[order], model[order], at[order]
            begins = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(model) != 0)])
            words = expand(text.as_py()).split()
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(place)]):
                start, size = int(place[a]), b - a
                body = b" ".join(words[start : start + size + window - 1])
                out.append((row.as_py(), start, size, int(model[a]), int(at[a]), body))
                held += len(body)
                if held > 4_000_000:
                    yield _claims(out)
                    out, held = [], 0
        yield _claims(out)


CLAIMS = "row long, start int, size int, model long, at int, words binary"
VERDICTS = "row long, start int, size int, same boolean"


def _claims(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["row", "start", "size", "model", "at", "words"])


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """First place and length of each run of true values."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    yield from zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


def _compared(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Which claimed windows have their model's words: for both texts; and which have not."""
    last, words = None, []
    for batch in batches:
        out: list[tuple] = []
        for row, start, size, model, at, claimed, text in zip(*[batch.column(c) for c in ("row", "start", "size", "model", "at", "words", "text")]):
            row, start, size, model, at, claimed = (v.as_py() for v in (row, start, size, model, at, claimed))
            if model != last:
                last, words = model, expand(text.as_py()).split()
            other = words[at : at + size + window - 1]
            if b" ".join(other) == claimed:
                out += [(row, start, size, True), (model, at, size, True)]
                continue
            differ = np.array([x != y for x, y in zip(claimed.split(), other)])
            wrong = np.r_[0, np.cumsum(differ)]
            same = wrong[window:] == wrong[:-window]
            for a, n in _runs(same):
                out += [(row, start + a, n, True), (model, at + a, n, True)]
            for a, n in _runs(~same):
                out += [(row, start + a, n, False), (model, at + a, n, False)]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["row", "start", "size", "same"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hash_bits: int = 64) -> DataFrame:
    """key, n_words, n_removed, kept_text: each whole text without the words of repeated windows.

    Words are runs without ASCII white space, kept unchanged and joined by one space. A window
    is ``window`` consecutive words of one text; it is repeated if its words also start
    anywhere else in the input, the same text included. Null and empty texts have no words;
    texts shorter than a window stay whole. Rows of one id are separate texts that count as
    copies of each other, and so are rows without one. Other columns are ignored. An empty
    table gives an empty result. ``hash_bits`` sets how much of the first round's hash is used;
    the result is the same for any number, as words decide, and needs no more rounds.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window needs {PERIOD + 4} words at least")
    steps, width = Steps(docs.sparkSession), window - PERIOD + 1
    given = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    used = np.uint64((1 << 64) - (1 << 64 - hash_bits))

    def keys_of(hashes: np.ndarray, size: int) -> np.ndarray:
        return windows(hashes, size) & used

    def byte_keys(text: bytes, places: np.ndarray, turn: int) -> np.ndarray:
        words, salt = text.split(), turn.to_bytes(8, "little")
        return np.frombuffer(b"".join([blake2b(b" ".join(words[p : p + window]), digest_size=8, key=salt).digest() for p in places.tolist()]), "<u8")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch):
                packed = pa.array([squeeze(t) for t in texts], pa.binary())
                rows, sizes = batch.slice(start, len(texts)), pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc"), sizes, pa.array(word_counts(texts), pa.int64()), packed], names=["row", "doc", "n_bytes", "n_words", "text"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for start, texts in text_chunks(batch, read=expand):
                hashes, at = hash_words(texts)
                for i in range(len(texts)):
                    keys = keys_of(hashes[at[i] : at[i + 1]], width)[anchors(at[i + 1] - at[i], window)]
                    yield from packer.add(rows[start + i], keys)
        yield from packer.flush()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows around repeated anchors of each text."""
        for batch in batches:
            parts = batch.column("anchors").to_pylist()
            for start, texts in text_chunks(batch, read=expand):
                hashes, at = hash_words(texts)
                candidates = []
                for i in range(len(texts)):
                    n = int(at[i + 1] - at[i])
                    places = anchors(n, window)
                    hit = places[np.isin(keys_of(hashes[at[i] : at[i + 1]], width)[places] & LOW, np.frombuffer(parts[start + i], np.uint64))]
                    near = np.unique(np.clip(hit[:, None] - np.arange(PERIOD), 0, n - window))
                    candidates.append(near.astype("<u4").tobytes() if len(near) else None)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, len(texts)) for c in ("row", "text")] + [pa.array(candidates, pa.binary())], names=["row", "text", "candidates"])

    def second(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(buckets)
        for batch in batches:
            rows, spots = batch.column("row").to_pylist(), batch.column("candidates").to_pylist()
            for start, texts in text_chunks(batch, read=expand):
                hashes, at = hash_words(texts) if not turn else (None, None)
                for i in range(len(texts)):
                    places = np.frombuffer(spots[start + i], "<u4")
                    keys = byte_keys(texts[i], places, turn) if turn else keys_of(hashes[at[i] : at[i + 1]], window)[places]
                    yield from matcher.add(rows[start + i], places, keys)
        yield from matcher.flush()

    def spots(runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs:
            listed = [np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["size"]) for r in runs_])).astype("<u4").tobytes() for runs_ in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(listed, pa.binary())], names=["row", "text", "candidates"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch, read=expand):
                rows = batch.slice(start, len(texts))
                removed, kept = [], []
                for body, runs in zip(texts, rows.column("runs").to_pylist()):
                    words = body.split()
                    edge = np.zeros(len(words) + 1, np.int32)
                    for r in runs or ():
                        edge[r["start"]] += 1
                        edge[r["start"] + r["size"] + window - 1] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    removed.append(int((~keep).sum()))
                    kept.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k) if removed[-1] else b" ".join(words))
                yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

    kind = docs.schema[key].dataType.simpleString()
    texts = steps.keep(given.mapInArrow(store, f"row long, doc {kind}, n_bytes long, n_words long, text binary"), "texts")
    buckets = buckets_for(texts)
    n = len(buckets)
    long_enough = texts.where(F.col("n_words") >= window).select("row", "text")
    repeated = by_bucket(long_enough.mapInArrow(first, PACKED), n).applyInArrow(lambda t: _repeats(t, buckets), "part int, owner binary, keys binary")
    anchored = by_part(repeated, n).applyInArrow(_anchored, "row long, anchors binary")
    opened = long_enough.join(anchored, "row").mapInArrow(extend, "row long, text binary, candidates binary").where("candidates IS NOT NULL")
    opened = steps.keep(opened, "open0")
    verdicts, turn = None, 0
    while True:
        matched = by_bucket(opened.mapInArrow(lambda b, turn=turn: second(b, turn), PACKED), n).applyInArrow(lambda t: _matched(t, buckets), "part int, owner binary, places binary, models binary, at binary")
        listed = by_part(matched, n).applyInArrow(_listed, MATCHES)
        claims = opened.select("row", "text").join(listed, "row").mapInArrow(lambda b: _pieces(b, window), CLAIMS)
        models = opened.select(F.col("row").alias("model"), "text")
        found = steps.keep(claims.join(models, "model").mapInArrow(lambda b: _compared(b, window), VERDICTS).distinct(), f"verdicts{turn}")
        verdicts = found if verdicts is None else verdicts.unionByName(found)
        wrong = found.where("NOT same")
        if wrong.isEmpty():
            break
        turn += 1
        again = wrong.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
        opened = steps.keep(opened.select("row", "text").join(again, "row").mapInArrow(spots, "row long, text binary, candidates binary"), f"open{turn}")
        steps.drop(f"open{turn - 1}")
    steps.drop(f"open{turn}")
    runs = verdicts.where("same").groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    final = texts.join(runs, "row", "left").select("doc", "n_words", "text", "runs")
    return final.mapInArrow(cut, f"doc {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("doc", key)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows of all documents removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
