"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Within a shard, x gets one more component sqrt(M^2 - |x|^2), M the shard's largest norm, and
a query gets 0 there; then a smaller Euclidean distance is a larger inner product. A subtree
is skipped when the triangle inequality puts it beyond the current k-th distance divided by
``factor``. With factor 1 the search is exact; a larger factor skips more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.llm.postings import even_numbers
from siltwork.llm.shared import Steps, lengths_of, matrix, pair_dot, usable_vectors

NEIGHBOURS = 20
FACTOR = 1.0
SHARD_ROWS = 16_384
LEAST_SHARDS = 12
QUERY_ROWS = 2_048
LEAF = 256
SLACK = 1e-9
MOST_TASKS = 4096


class VantageTree:
    """A vantage-point tree over the rows of a matrix; rows of a subtree are contiguous in ``order``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 1):
        self.ids, self.x = ids, vectors
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.most = float(squares.max(initial=0.0))
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(self.most - squares, 0))])
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, float, int, int] | None] = []  # vantage row, radius, inside, outside
        self.spans: list[tuple[int, int]] = []
        self.random = np.random.default_rng(seed)
        self.root = self._grow(0, len(ids)) if len(ids) else -1

    def _grow(self, start: int, end: int) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        self.spans.append((start, end))
        if end - start <= LEAF:
            return node
        rows = self.order[start:end]
        at = int(self.random.integers(len(rows)))
        rows[0], rows[at] = rows[at], rows[0]
        vantage, rest = rows[0], rows[1:]
        distance = np.linalg.norm(self.points[rest] - self.points[vantage], axis=1)
        half = len(rest) // 2
        sorted_rest = np.argpartition(distance, half)
        radius = float(distance[sorted_rest[half]])
        rows[1:] = rest[sorted_rest]
        inside = self._grow(start + 1, start + 1 + half)
        outside = self._grow(start + 1 + half, end)
        self.nodes[node] = (int(vantage), radius, inside, outside)
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the best k of each query; ties go to smaller ids."""
        n = len(queries)
        self.q, self.q_ids, self.k, self.factor = queries, query_ids, k, factor
        self.q_squares = np.einsum("ij,ij->i", queries, queries)
        self.q_points = np.column_stack([queries, np.zeros(n)])
        self.scores = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        if self.root >= 0:
            self._visit(self.root, np.arange(n))
        rows, places = np.nonzero(self.scores > -np.inf)
        return rows, self.found[rows, places], self.scores[rows, places]

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The distance within which a better neighbour can lie."""
        square = self.most + self.q_squares[q] - 2 * self.scores[q, -1]
        return np.sqrt(np.maximum(square, 0)) / self.factor + SLACK * (1 + np.sqrt(self.most + self.q_squares[q]))

    def _offer(self, rows: np.ndarray, q: np.ndarray) -> None:
        rough = self.q[q] @ self.x[rows].T
        margin = SLACK * (1 + np.sqrt(self.most * self.q_squares[q]))
        at, column = np.nonzero(rough >= (self.scores[q, -1] - margin)[:, None])
        which, row = q[at], rows[column]
        other = self.ids[row] != self.q_ids[which]
        which, row = which[other], row[other]
        if not len(which):
            return
        score = pair_dot(self.q[which], self.x[row])
        touched = np.unique(which)
        all_q = np.concatenate([which, np.repeat(touched, self.k)])
        all_s = np.concatenate([score, self.scores[touched].ravel()])
        all_i = np.concatenate([self.ids[row], self.found[touched].ravel()])
        order = np.lexsort((all_i, -all_s, all_q))
        starts = np.searchsorted(all_q[order], touched)
        taken = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.scores[touched] = all_s[taken].reshape(-1, self.k)
        self.found[touched] = all_i[taken].reshape(-1, self.k)

    def _visit(self, node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if self.nodes[node] is None:
            start, end = self.spans[node]
            self._offer(self.order[start:end], q)
            return
        vantage, radius, inside, outside = self.nodes[node]
        self._offer(np.array([vantage]), q)
        distance = np.linalg.norm(self.q_points[q] - self.points[vantage], axis=1)
        near = distance < radius
        self._visit(inside, q[near])
        self._visit(outside, q[~near])
        late = ~near & (distance - radius <= self._reach(q))
        self._visit(inside, q[late])
        late = near & (radius - distance <= self._reach(q))
        self._visit(outside, q[late])


PACKED = "number int, numbers binary, ids binary, vectors binary"
FOUND = "query long, query_id long, vec_id long, score double"


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row per partition: its number, and its rows' numbers, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            columns = [np.concatenate([b.column(c).to_numpy() for b in got]).tobytes() for c in ("number", "id")]
            whole = np.concatenate([matrix(b) for b in got]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([c], pa.binary()) for c in (*columns, whole)]], names=["number", "numbers", "ids", "vectors"])

    return rows.repartition(parts, F.xxhash64("id", "number")).mapInArrow(run, PACKED)


def _of_one_length(base: DataFrame, asked: DataFrame, n_base: int, n_asked: int, size: int, k: int, factor: float) -> DataFrame:
    """query, query_id, vec_id, score: of each query row the best k of each shard."""
    shards, blocks = max(LEAST_SHARDS, -(-n_base // SHARD_ROWS)), max(1, -(-n_asked // QUERY_ROWS))
    numbers = even_numbers(base.sparkSession, shards)
    place = F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("number")) if shards <= MOST_TASKS else F.col("number")
    first = _packed(base, shards).select(place.alias("shard"), F.lit(-1).alias("turn"), "numbers", "ids", "vectors")
    every = F.array(*[F.lit(int(n)) for n in numbers]) if shards <= MOST_TASKS else F.sequence(F.lit(0), F.lit(shards - 1))
    later = _packed(asked, blocks).select(F.explode(every).alias("shard"), F.col("number").alias("turn"), "numbers", "ids", "vectors")
    work = first.unionByName(later).repartition(min(MOST_TASKS, shards), "shard").sortWithinPartitions("shard", "turn")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first and make its tree; query blocks stream past it."""
        shard, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)  # noqa: B023, E731
                ids, vectors = get("ids", np.int64), get("vectors", np.float64).reshape(-1, size)
                now = batch.column("shard")[r].as_py()
                if batch.column("turn")[r].as_py() < 0:
                    shard, tree = now, VantageTree(ids, vectors)
                elif now == shard:
                    q, found, scores = tree.search(ids, vectors, k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(get("numbers", np.int64)[q]), pa.array(ids[q]), pa.array(found), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])

    return work.mapInArrow(search, FOUND)


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k rows of largest inner product, none of its own id.

    Vectors that cannot be compared (see ``usable_vectors``) take no part, and vectors meet only
    those of their own length. Each row of a repeated id is a query and a candidate of its own.
    Fewer than k candidates: all of them. Ties go to the smaller id. Empty tables give an empty
    result. Each shard's tree is built once, and the query blocks stream past it; a shard returns
    at most k rows per query, so the last ranking sees k times the shards of rows per query.
    """
    steps, number = Steps(rows.sparkSession), F.monotonically_increasing_id().alias("number")
    base = steps.keep(usable_vectors(rows, key, vector).select("id", "vector", number), "base")
    asked = steps.keep(usable_vectors(queries, key, vector).select("id", "vector", number), "asked")
    wanted = dict(lengths_of(asked))
    found = rows.sparkSession.createDataFrame([], FOUND)
    for size, n in lengths_of(base):
        if size in wanted:
            own = F.size("vector") == size
            found = found.unionByName(_of_one_length(base.where(own), asked.where(own), n, wanted[size], size, k, factor))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


