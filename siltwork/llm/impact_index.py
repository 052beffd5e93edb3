"""Ranked lexical search over a bit-sliced impact index.

A shard is up to so many documents of one task's input, in order of id. Of each of its terms
the index holds the places of the term's documents and, bit by bit, a bitmap of their impacts:
``(1000000000 tf) div (1000 tf + 8 m)``, below 2^20. A query term's weight is put to it by
shifts and additions of whole bitmaps, and the terms of a query are added by carry-save
arithmetic: sum and carry are bitwise functions of three numbers, so one operation adds all
documents of a shard. The best k are found from the highest slice down, by intersections and
counts of bits; ties are settled by place. Only those k leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.llm.shared import Steps

RESULTS = 10
IMPACT_BITS = 20
#: A shard ends at so many documents or bytes of text, or with its task's input.
SHARD_DOCS = 16_384
SHARD_BYTES = 24_000_000
READ_BYTES = 1_000_000
PAIRS_AT_ONCE = 100_000
BLOCK_ITEMS = 64
#: Query terms are joined by broadcast up to so many rows (a term is at most TERM_BYTES long there), else by shuffle.
BROADCAST_TERMS = 200_000
BROADCAST_BYTES = 16_000_000
SALT = 32

_TERM = np.zeros(256, bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _TERM[ord(_first) : ord(_last) + 1] = True
_TERM[128:] = True
_FOLDED = bytes(ord(chr(b).lower()) if b < 128 and _TERM[b] else b if _TERM[b] else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of UTF-8 text: runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLDED).split()


def term_counts(texts: list[bytes]) -> np.ndarray:
    """How many terms each text has, with repeats."""
    term = _TERM[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    start = np.flatnonzero(term & np.r_[True, ~term[:-1]])
    return np.diff(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts])))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight one adds to a document of n terms that holds it tf times."""
    m = 10 + (90 * n.astype(np.int64) * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


# Bitmaps: a number per document is a matrix of 64-bit words, a row per bit, lowest first.


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit-slices of whole numbers, in words of 64 documents."""
    whole = np.zeros((bits, -(-len(values) // 64) * 64), np.uint8)
    whole[:, : len(values)] = values[None, :] >> np.arange(bits)[:, None] & 1
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


def dense(places: np.ndarray, packed: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Slices over a whole shard, from those over the places of a term's documents."""
    whole = np.zeros((bits, -(-size // 64) * 64), np.uint8)
    count = len(places)
    whole[:IMPACT_BITS, places] = np.unpackbits(packed, count=IMPACT_BITS * count, bitorder="little").reshape(IMPACT_BITS, count)
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


def _up(slices: np.ndarray, by: int) -> np.ndarray:
    """Times two to the power ``by``."""
    out = np.zeros_like(slices)
    out[by:] = slices[: len(slices) - by]
    return out


class Sum:
    """A sum of bit-sliced numbers, kept as sum and carry until it is read."""

    def __init__(self, bits: int, words: int):
        self.sum, self.carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)

    def add(self, slices: np.ndarray) -> None:
        half = self.sum ^ self.carry
        carry = _up((self.sum & self.carry) | (half & slices), 1)
        self.sum, self.carry = half ^ slices, carry

    def total(self) -> np.ndarray:
        out, carry = np.empty_like(self.sum), np.zeros(self.sum.shape[1], np.uint64)
        for b in range(len(out)):
            half = self.sum[b] ^ self.carry[b]
            out[b] = half ^ carry
            carry = (self.sum[b] & self.carry[b]) | (half & carry)
        return out


def times(slices: np.ndarray, weight: int) -> np.ndarray:
    """Slices of weight times the number, by shifts and additions."""
    out = Sum(*slices.shape)
    for b in range(weight.bit_length()):
        if weight >> b & 1:
            out.add(_up(slices, b))
    return out.total()


def places_in(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_places(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the k largest above zero, found from the highest slice down; ties by place."""
    sure, open_ = np.zeros(slices.shape[1], np.uint64), np.bitwise_or.reduce(slices, axis=0)
    if int(np.bitwise_count(open_).sum()) > k:
        for b in range(len(slices) - 1, -1, -1):
            with_bit = sure | (open_ & slices[b])
            n = int(np.bitwise_count(with_bit).sum())
            if n > k:
                open_ = open_ & slices[b]
            else:
                sure, open_ = with_bit, open_ & ~slices[b]
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
    sure_places = places_in(sure)
    places = np.concatenate([sure_places, places_in(open_)[: k - len(sure_places)]])
    bits = slices[:, places >> 6] >> (places & 63).astype(np.uint64)[None, :] & np.uint64(1)
    return places, (bits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0)


@dataclass
class Index:
    """``postings`` (shard, term, df, places, slices), ``shards`` (shard, doc_ids) and the corpus counts."""

    postings: DataFrame
    shards: DataFrame
    n_docs: int
    n_terms: int
    steps: Steps


POSTINGS = "shard long, term binary, df int, places binary, slices binary, doc_ids array<long>"


def _shard_rows(shard: int, ids: list, codes: list[pa.Array], counts: list[np.ndarray], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard: its terms, and one row with its documents' ids."""
    n = np.concatenate(counts)
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    names = ["shard", "term", "df", "places", "slices", "doc_ids"]
    none = pa.array([None], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([shard]), none, pa.array([0], pa.int32()), none, none, pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))], names=names)
    whole = pa.chunked_array(codes).unify_dictionaries()
    code = np.concatenate([c.indices.to_numpy() for c in whole.chunks]).astype(np.int64)
    if not len(code):
        return
    terms = whole.chunks[0].dictionary
    pair, tf = np.unique(code * len(ids) + np.repeat(place, n), return_counts=True)
    del code
    term, at = pair // len(ids), pair % len(ids)
    impact = impacts(tf, n[order][at], n_docs, n_terms)
    begins = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)]
    for first, last in _parts(begins, PAIRS_AT_ONCE):
        a, b = int(begins[first]), int(begins[last])
        size = np.diff(begins[first : last + 1])
        start = begins[first:last] - a
        sizes = np.repeat(size, size)
        bytes_each = (IMPACT_BITS * size + 7) // 8
        offset = np.r_[0, np.cumsum(bytes_each)]
        # Slice by slice within each term: bit s of its j-th document stands at s * size + j.
        base = np.repeat(8 * offset[:-1], size) + np.arange(b - a) - np.repeat(start, size)
        bits = np.zeros(8 * int(offset[-1]), np.uint8)
        for s in range(IMPACT_BITS):
            bits[base + s * sizes] = impact[a:b] >> s & 1
        packed, places = np.packbits(bits, bitorder="little"), at[a:b].astype("<u4")
        count = last - first
        column = lambda ends, body: pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.asarray(ends, np.int32).tobytes()), pa.py_buffer(body.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, shard)), terms.take(pa.array(term[begins[first:last]])).cast(pa.binary()), pa.array(size.astype(np.int32)), column(4 * (begins[first : last + 1] - a), places), column(offset, packed), pa.nulls(count, pa.list_(pa.int64()))],
            names=names,
        )


def _parts(begins: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about so many pairs; a longer run comes alone."""
    part = begins[:-1] // most
    edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """ids and texts, in slices of about READ_BYTES."""
    ids, texts, size = [], [], 0
    for batch in batches:
        values = batch.column("text").cast(pa.binary())
        for i, doc in enumerate(batch.column("doc").to_pylist()):
            text = values[i].as_py() or b""
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= READ_BYTES or len(ids) >= SHARD_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of whole texts, written to the shared folder.

    A null text has no term; rows without terms stay in no posting and in no count. Rows of one
    id are documents of their own; a null id comes last among ties. Other columns are ignored.
    """
    steps = Steps(docs.sparkSession)
    given = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, terms = 0, 0
        for _, texts in _reads(batches):
            n = term_counts(texts)
            docs_, terms = docs_ + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs_]), pa.array([terms])], names=["docs", "terms"])

    totals = given.mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, codes, counts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for more, texts in _reads(batches):
            if ids and (len(ids) + len(more) > SHARD_DOCS or size + sum(map(len, texts)) > SHARD_BYTES):
                yield from _shard_rows(shard, ids, codes, counts, n_docs, n_terms)
                shard, ids, codes, counts, size = shard + 1, [], [], [], 0
            ids, size = ids + more, size + sum(map(len, texts))
            codes.append(pa.array(terms_of(b" ".join(texts)), pa.binary()).dictionary_encode())
            counts.append(term_counts(texts))
        if ids:
            yield from _shard_rows(shard, ids, codes, counts, n_docs, n_terms)

    stored = steps.keep(given.mapInArrow(index, POSTINGS), "index")
    return Index(stored.where("term IS NOT NULL").drop("doc_ids"), stored.where("term IS NULL").select("shard", "doc_ids"), n_docs, n_terms, steps)


BEST = "item long, doc_id long, score long"


def _best_of_shard(table: pa.Table, k: int) -> pa.Table:
    """The k best documents of a shard for each query of a block."""
    ids, size = [], 0
    rows = []
    for batch in table.to_batches():
        for r in range(batch.num_rows):
            if batch.column("term")[r].as_py() is None:
                ids = batch.column("doc_ids")[r].as_py()
            else:
                rows.append((batch, r))
    size = len(ids)
    weight = np.array([b.column("weight")[r].as_py() for b, r in rows], np.int64)
    items = [np.frombuffer(b.column("items")[r].as_py(), np.int64) for b, r in rows]
    most: dict[int, int] = {}
    for w, asking in zip(weight.tolist(), items):
        for i in asking.tolist():
            most[i] = most.get(i, 0) + (w << IMPACT_BITS)
    bits = max(max(most.values(), default=1).bit_length(), IMPACT_BITS)
    sums: dict[int, Sum] = {}
    for (batch, r), w, asking in zip(rows, weight.tolist(), items):
        places = np.frombuffer(batch.column("places")[r].as_py(), "<u4")
        term = times(dense(places, np.frombuffer(batch.column("slices")[r].as_py(), np.uint8), size, bits), w)
        for i in asking.tolist():
            if i not in sums:
                sums[i] = Sum(*term.shape)
            sums[i].add(term)
    out: list[list] = [[], [], []]
    for i, added in sums.items():
        places, scores = top_places(added.total(), k)
        out[0] += [i] * len(places)
        out[1] += [ids[p] for p in places.tolist()]
        out[2] += scores.tolist()
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("item", "doc_id", "score"), out)})


def _beside(large: DataFrame, small: DataFrame, n_rows: int, n_bytes: int) -> DataFrame:
    """``large`` with the rows of ``small`` of the same term: broadcast if it is of checked size, else with hot terms dealt over SALT partitions by shard."""
    if n_rows <= BROADCAST_TERMS and n_bytes <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), "term")
    dealt = large.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALT)).cast("int"))
    return dealt.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["term", "salt"]).drop("salt")


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", k: int = RESULTS) -> DataFrame:
    """item_id, rank, doc_id, score: of each query row the k documents of highest score above 0.

    A term counts once per query. Each row of a repeated item id is a query of its own; null
    and empty texts find nothing. Equal scores go by doc_id, a null one last. Other columns are
    ignored. Queries are worked on in blocks of about BLOCK_ITEMS, shard by shard.
    """
    steps = index.steps
    asked = items.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("item"))
    asked = steps.keep(asked, "asked")
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py() or b""))) for t in batch.column("text").cast(pa.binary())]
            who = np.repeat(batch.column("item").to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([t for f in found for t in f], pa.binary())], names=["item", "term"])

    terms = steps.keep(asked.select("item", "text").mapInArrow(split, "item long, term binary"), "terms")
    names = steps.keep(terms.select("term").distinct(), "names")
    size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    df = _beside(index.postings.select("shard", "term", "df"), names, size[0], size[1]).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long").alias("weight")

    def gather(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        who = pa.array([np.sort(table.column("item").to_numpy()).tobytes()], pa.binary())
        return pa.table({"block": first.column("block"), "term": first.column("term"), "weight": first.column("weight"), "items": who})

    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    weighted = terms.join(df.select("term", weight), "term").select(block, "term", "weight", "item")
    weighted = steps.keep(weighted.groupBy("block", "term").applyInArrow(gather, "block int, term binary, weight long, items binary"), "weighted")
    size = weighted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + F.octet_length("items")), F.lit(0))).first()
    hits = _beside(index.postings, weighted, size[0], size[1]).select("shard", "block", "term", "weight", "items", "places", "slices", F.lit(None).cast("array<long>").alias("doc_ids"))
    every = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "binary"), ("weight", "long"), ("items", "binary"), ("places", "binary"), ("slices", "binary"))]
    work = hits.unionByName(every.select("shard", "block", *none, "doc_ids"))
    found = work.groupBy("shard", "block").applyInArrow(lambda t: _best_of_shard(t, k), BEST)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(key), "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
