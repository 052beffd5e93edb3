"""Exact top-k by inner product of whole numbers: an M-tree per shard, searched best first.

A vector x gets one more component sqrt(M - |x|^2), M the shard's largest square; a query gets
0 there. A smaller Euclidean distance is then a larger inner product, and distances obey the
triangle inequality. A tree's pages hold objects with their distance to the page's parent
object and, above the leaves, a covering radius and a child page. Of each query the pending
page of least possible distance comes next, until none can hold a better row. On a page the
stored distances say which objects cannot matter; only the others are computed.

Work is dealt as cells of row pieces and query groups: a cell keeps the best k of its queries
while the trees of its piece's shards pass by one after the other, so later shards meet tight
bounds, and k rows per query leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.llm.postings import even_numbers
from siltwork.llm.shared import Steps

NEIGHBOURS = 20
SCALE = 64
SHARD_ROWS = 16_384
PIECE_SHARDS = 64
GROUP_QUERIES = 65_536
BLOCK_QUERIES = 2_048
LEAST_CELLS = 12
MOST_TASKS = 4096
PAGE = 512
FANOUT = 16
SLACK = 1e-9
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


class Dots:
    """Inner products of whole numbers given as doubles, exact at any size.

    As doubles while no sum can pass 2^53, as 64-bit integers below 2^63, else as Python's own,
    held at the ends of 64 bits.
    """

    def __init__(self, most_square: float, query_square: float):
        bound = float(np.sqrt(most_square) * np.sqrt(query_square)) * 1.001 + 1
        self.kind = 0 if bound < 2.0**53 and max(most_square, query_square) < 2.0**53 else 1 if bound < 2.0**62 and max(most_square, query_square) < 2.0**124 else 2

    def __call__(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.kind == 0:
            return (q @ x.T).astype(np.int64)
        if self.kind == 1:
            return q.astype(np.int64) @ x.astype(np.int64).T
        whole = np.frompyfunc(int, 1, 1)
        sums = np.dot(whole(q), whole(x).T) if q.shape[1] else np.zeros((len(q), len(x)), object)
        return np.array(np.clip(sums, NONE + 1, LAST), dtype=np.int64)


class Best:
    """The best k rows of each of n queries: highest score first, ties by smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), LAST, np.int64)

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        """Scores of rows ``ids`` (columns) for queries ``q`` (rows); at most ``own`` of them have a query's id."""
        least, place = self.scores[q, -1], scores.shape[1] - self.k - own
        if place > 0:
            least = np.maximum(least, np.partition(scores, place, axis=1)[:, place])
        at, column = np.nonzero(scores >= least[:, None])
        other = ids[column] != self.ids[q[at]]
        at, column = at[other], column[other]
        if not len(at):
            return
        which = q[at]
        touched = np.unique(which)
        all_q = np.concatenate([which, np.repeat(touched, self.k)])
        all_s = np.concatenate([scores[at, column], self.scores[touched].ravel()])
        all_i = np.concatenate([ids[column], self.found[touched].ravel()])
        order = np.lexsort((all_i, -1 - all_s, all_q))
        taken = order[(np.searchsorted(all_q[order], touched)[:, None] + np.arange(self.k)).ravel()]
        self.scores[touched] = all_s[taken].reshape(-1, self.k)
        self.found[touched] = all_i[taken].reshape(-1, self.k)


class Page:
    """Objects (rows of the shard), their distances to the parent object, and above the leaves radii and children."""

    def __init__(self, rows: np.ndarray, parent_distance: np.ndarray, radius: np.ndarray | None = None, child: np.ndarray | None = None):
        self.rows, self.parent_distance, self.radius, self.child = rows, parent_distance, radius, child


class MetricTree:
    """An M-tree, loaded in bulk: seeds become routing objects, each row goes to its nearest seed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max(initial=1))
        squares = np.einsum("ij,ij->i", self.x, self.x)
        self.most = float(squares.max(initial=0.0))
        self.points = np.column_stack([self.x, np.sqrt(np.maximum(self.most - squares, 0))])
        self.page, self.fanout, self.random = page, fanout, np.random.default_rng(seed)
        self.pages: list[Page] = []
        self.computed = self.met = 0
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else -1

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        square = self.most * 2 - 2 * (self.points[rows] @ self.points[to].T)
        same = rows[:, None] == to[None, :]
        return np.where(same, 0.0, np.sqrt(np.maximum(square, 0)))

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        number = len(self.pages)
        self.pages.append(None)  # type: ignore[arg-type]
        if len(rows) <= self.page:
            self.pages[number] = Page(rows, self._to_parent(rows, parent))
            return number
        # No more children than fill their pages.
        seeds = self.random.choice(rows, max(2, min(self.fanout, -(-3 * len(rows) // (2 * self.page)))), replace=False)
        distance = self._distances(rows, seeds)
        nearest = distance.argmin(1)
        if np.bincount(nearest, minlength=len(seeds)).max() > 0.9 * len(rows):  # many equal rows
            nearest = np.arange(len(rows)) * len(seeds) // len(rows)
        used = np.flatnonzero(np.bincount(nearest, minlength=len(seeds)))
        radius = np.array([distance[nearest == j, j].max() for j in used])
        child = np.array([self._load(rows[nearest == j], int(seeds[j])) for j in used])
        self.pages[number] = Page(seeds[used], self._to_parent(seeds[used], parent), radius, child)
        return number

    def _to_parent(self, rows: np.ndarray, parent: int | None) -> np.ndarray:
        return np.zeros(len(rows)) if parent is None else self._distances(rows, np.array([parent]))[:, 0]

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Improves the best rows of all queries by this shard's."""
        for start in range(0, len(queries) if self.root >= 0 else 0, BLOCK_QUERIES):
            self._search(queries, np.arange(start, min(len(queries), start + BLOCK_QUERIES)), best)

    def _search(self, queries: np.ndarray, block: np.ndarray, best: Best) -> None:
        x, squares = queries[block], np.einsum("ij,ij->i", queries[block], queries[block])
        dots = Dots(self.most, float(squares.max(initial=0.0)))
        slack = SLACK * (1 + np.sqrt(self.most + squares))

        def reach(q: np.ndarray) -> np.ndarray:
            kth = best.scores[block[q], -1]
            square = self.most + squares[q] - 2 * kth.astype(np.float64)
            return np.where(kth == NONE, np.inf, np.sqrt(np.maximum(square, 0)) + slack[q] * (1 if dots.kind == 0 else 1e3))

        pending = np.full((len(block), len(self.pages)), np.inf)
        to_object = np.zeros_like(pending)
        pending[:, self.root] = 0
        while True:
            page = pending.argmin(1)
            going = np.flatnonzero(pending[np.arange(len(block)), page] <= reach(np.arange(len(block))))
            going = going[np.isfinite(pending[going, page[going]])]
            if not len(going):
                return
            going = going[np.argsort(page[going], kind="stable")]
            cut = np.flatnonzero(np.r_[True, np.diff(page[going]) != 0, True])
            for a, b in zip(cut[:-1], cut[1:]):
                q, p = going[a:b], int(page[going[a]])
                pending[q, p] = np.inf
                self._visit(p, q, x, squares, dots, reach, pending, to_object, best, block)

    def _visit(self, p: int, q: np.ndarray, x, squares, dots: Dots, reach, pending, to_object, best: Best, block: np.ndarray) -> None:
        page = self.pages[p]
        limit = reach(q)
        near = np.ones((len(q), len(page.rows)), bool)
        if p != self.root:
            apart = np.abs(to_object[q, p][:, None] - page.parent_distance[None, :])
            near = apart <= limit[:, None] if page.radius is None else apart - page.radius[None, :] <= limit[:, None]
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        self.met += near.size
        self.computed += len(rows) * len(columns)
        if not len(rows):
            return
        q, objects = q[rows], page.rows[columns]
        score = dots(x[q], self.x[objects])
        if page.radius is None:
            best.offer(block[q], self.ids[objects], score, self.repeats)
            return
        distance = np.sqrt(np.maximum(self.most + squares[q][:, None] - 2 * score.astype(np.float64), 0))
        least = np.maximum(distance - page.radius[columns][None, :], 0)
        least[~near[np.ix_(rows, columns)] | (least > limit[rows][:, None])] = np.inf
        where = np.ix_(q, page.child[columns])
        pending[where], to_object[where] = least, distance


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id, size, vector: each component floor(scale * x), as doubles; see ``exact_top_k`` for what is left out."""
    given = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    scaled = given.where("id IS NOT NULL AND vector IS NOT NULL").withColumn("vector", F.transform("vector", lambda x: x * F.lit(float(scale))))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return scaled.where(~bad).select("id", F.size("vector").alias("size"), "vector")


PACKED = "size int, part int, numbers binary, ids binary, wide boolean, vectors binary"


def _packed(rows: DataFrame) -> DataFrame:
    """One row per size and part: numbers, ids and floored vectors as bytes, in 16 bits where they fit."""

    def pack(table: pa.Table) -> pa.Table:
        flat = np.floor(np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in table.column("vector").chunks]))
        wide = bool(len(flat)) and bool(np.abs(flat).max() > 32_000)
        columns = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("number", "id")]
        body = flat.tobytes() if wide else flat.astype("<i2").tobytes()
        first = [table.column(c)[0].as_py() for c in ("size", "part")]
        return pa.table({"size": pa.array(first[:1], pa.int32()), "part": pa.array(first[1:], pa.int32()), "numbers": pa.array(columns[:1], pa.binary()), "ids": pa.array(columns[1:], pa.binary()), "wide": pa.array([wide]), "vectors": pa.array([body], pa.binary())})

    return rows.groupBy("size", "part").applyInArrow(pack, PACKED)


FOUND = "query long, query_id long, vec_id long, score long"


def _cell_search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per cell its queries, then shard after shard; the best k of each query at the end."""
    cell, queries, shards = None, [], 0
    numbers = vectors = best = None

    def result() -> Iterator[pa.RecordBatch]:
        if best is not None:
            q, place = np.nonzero(best.scores > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(best.ids[q]), pa.array(best.found[q, place]), pa.array(best.scores[q, place])], names=["query", "query_id", "vec_id", "score"])

    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
            size, ids = get("size"), np.frombuffer(get("ids"), np.int64)
            body = np.frombuffer(get("vectors"), np.float64 if get("wide") else "<i2").astype(np.float64).reshape(len(ids), size)
            if (get("cell"), size) != cell:
                yield from result()
                cell, queries, best = (get("cell"), size), [], None
            if get("turn") < 0:
                queries.append((np.frombuffer(get("numbers"), np.int64), ids, body))
                continue
            if queries and best is None:
                numbers, own, vectors = (np.concatenate([q[j] for q in queries]) for j in range(3))
                best, queries = Best(own, k), []
            if best is not None:
                MetricTree(ids, body).search(vectors, best)
    yield from result()


def exact_top_k(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k rows of highest inner product, none of its own id.

    Components are floor(scale * x) in doubles; scores are exact integers (held at the ends of
    64 bits). Null ids, null vectors and vectors with a null or non-finite component (also
    after scaling) take no part; zero vectors do. Vectors meet only those of their own length.
    Each row of a repeated id is a query and a candidate of its own. Fewer than k candidates:
    all of them. Ties go to the smaller id. Other columns are ignored. Empty tables give an
    empty result.
    """
    spark, number = rows.sparkSession, F.monotonically_increasing_id().alias("number")
    steps = Steps(spark)
    base = steps.keep(whole_vectors(rows, key, vector, scale).select("*", number), "base")
    asked = steps.keep(whole_vectors(queries, key, vector, scale).select("*", number), "asked")
    n_base, n_asked = base.count(), asked.count()
    groups = max(1, -(-n_asked // GROUP_QUERIES))
    pieces = max(-(-LEAST_CELLS // groups), -(-n_base // (SHARD_ROWS * PIECE_SHARDS)))
    shards = pieces * max(1, -(-n_base // (SHARD_ROWS * pieces)))
    cells = pieces * groups
    spread = F.xxhash64("id", "number")
    trees = _packed(base.withColumn("part", F.pmod(spread, F.lit(shards)).cast("int"))).withColumn("turn", F.col("part"))
    trees = trees.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.pmod("part", F.lit(pieces)) * groups + F.col("at"))
    asks = _packed(asked.withColumn("part", F.pmod(spread, F.lit(groups)).cast("int"))).withColumn("turn", F.lit(-1))
    asks = asks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("cell", F.col("at") * groups + F.col("part"))
    work = trees.unionByName(asks)
    if cells <= MOST_TASKS:  # a partition of its own for each cell
        work = work.withColumn("cell", F.get(F.array(*[F.lit(int(n)) for n in even_numbers(spark, cells)]), F.col("cell")))
    work = work.repartition(min(MOST_TASKS, cells), "cell").sortWithinPartitions("cell", "size", "turn")
    found = work.mapInArrow(lambda b: _cell_search(b, k), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every vector whose id is divisible by 20, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


OP11_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
    SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM whole
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
