"""Near-duplicate vectors by cosine: an epsilon grid order join.

Equal vectors form one class. Unit vectors are turned to principal axes, sorted by their
grid cells (cell width epsilon) on the leading axes, and cut into intervals of bounded size.
Neighbouring intervals are groups, and each pair of groups within epsilon is one task's cell:
one group is held, the other streams past it, so a vector travels once per group and not once
per interval. Interval pairs whose boxes are farther apart than epsilon are skipped; the rest
are halved recursively, skipping distant halves, down to small blocks whose cosines are
computed. A task returns link counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.postings import even_numbers
from siltwork.llm.shared import Steps, connected_components, lengths_of, local_components, matrix, pair_dot, partition_sums, usable_vectors

COSINE = 0.9
GRID_AXES = 6
BOX_AXES = 24
INTERVAL_ROWS = 16_384
LEAST_INTERVALS = 12
#: A group holds so many bytes of vectors; few vectors make so many groups at least.
GROUP_BYTES = 256_000_000
LEAST_GROUPS = 5
LEAF = 512
SLACK = 1e-9
MOST_TASKS = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(rows: DataFrame, size: int) -> np.ndarray:
    """Columns: directions of falling variance of the unit vectors, from partition sums."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        u = unit(matrix(batch))
        return np.vstack([u.T @ u, u.sum(0), np.full(u.shape[1], len(u))])

    sums = partition_sums(rows, (size + 2, size), part)
    n = max(1.0, sums[-1, 0])
    mean = sums[size] / n
    return np.linalg.eigh(sums[:size] / n - np.outer(mean, mean))[1][:, ::-1]


class Interval:
    """Rows of an interval in grid order, with boxes of any run of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, axes: np.ndarray, epsilon: float):
        turned = unit(vectors) @ axes
        cells = np.floor(turned[:, :GRID_AXES] / epsilon)
        order = np.lexsort((ids, *cells.T[::-1]))
        self.ids, self.sizes, self.raw = ids[order], sizes[order], vectors[order]
        self.norms = np.sqrt(pair_dot(self.raw, self.raw))
        self.unit, self.turned = self.raw / self.norms[:, None], turned[order]
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, end) not in self.boxes:
            part = self.turned[start:end, :BOX_AXES]
            self.boxes[start, end] = (part.min(0), part.max(0))
        return self.boxes[start, end]


def distant(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > epsilon * epsilon * (1 + 1e-9)


def join_intervals(a: Interval, b: Interval, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the rows of a and of b, and a spanning forest of the links (ids)."""
    same, na = a is b, len(a.ids)
    offset = 0 if same else na
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    stack = [(0, na, 0, len(b.ids))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1 or (same and b1 <= a0) or distant(a.box(a0, a1), b.box(b0, b1), epsilon):
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            if same and (a0, a1) == (b0, b1):
                stack += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
            elif a1 - a0 >= b1 - b0:
                stack += [(a0, am, b0, b1), (am, a1, b0, b1)]
            else:
                stack += [(a0, a1, b0, bm), (a0, a1, bm, b1)]
            continue
        cosines = a.unit[a0:a1] @ b.unit[b0:b1].T
        close = cosines >= cosine
        u, v = np.nonzero(np.abs(cosines - cosine) < SLACK)
        if len(u):
            exact = pair_dot(a.raw[a0 + u], b.raw[b0 + v]) / (a.norms[a0 + u] * b.norms[b0 + v])
            close[u, v] = exact >= cosine
        within = same and (a0, a1) == (b0, b1)
        if within:
            np.fill_diagonal(close, False)
        if not close.any():
            continue
        counts[a0:a1] += close @ b.sizes[b0:b1]
        if not within:
            counts[offset + b0 : offset + b1] += a.sizes[a0:a1] @ close
        u, v = np.nonzero(close)
        label = local_components(len(ids), u + a0, v + b0 + offset, label)
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return counts, ids, ids[linked], ids[label[linked]]


def _near_intervals(intervals: DataFrame, epsilon: float, size: int) -> DataFrame:
    """interval, with: pairs of intervals, or of groups of them, whose boxes lie within epsilon of each other.

    Boxes meet in cells of the leading axes: a box is listed under the cells it touches, the
    other one under these and their neighbours. Unit vectors have few cells, so a box has a
    bounded number; pairs come from an equi-join and not from all pairs of boxes.
    """
    axes = range(min(2, size))
    boxes = intervals.select("interval", "low", "high")

    def listed(rows: DataFrame, more: int, low: str, high: str) -> DataFrame:
        for k in axes:
            begin, end = F.floor(F.col(low)[k] / epsilon) - more, F.floor(F.col(high)[k] / epsilon) + more
            rows = rows.withColumn(f"cell{k}", F.explode(F.sequence(begin, end)))
        return rows

    other = boxes.select(F.col("interval").alias("with"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = listed(boxes, 0, "low", "high").join(listed(other, 1, "low2", "high2"), [f"cell{k}" for k in axes])
    gaps = F.transform(F.arrays_zip("low", "high", "low2", "high2"), lambda z: F.greatest(F.lit(0.0), z["low"] - z["high2"], z["low2"] - z["high"]))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon * (1 + 1e-9)
    return met.where((F.col("interval") <= F.col("with")) & near).select("interval", "with").distinct()


def _found_links(classes: DataFrame, n_classes: int, size: int, cosine: float, steps: Steps) -> DataFrame:
    """u, v, n among vectors of one length: with u = v the links of a class to others, else edges."""
    spark, epsilon = classes.sparkSession, float(np.sqrt(2 - 2 * cosine))
    axes = principal_axes(classes, size)
    parts = max(LEAST_INTERVALS, -(-n_classes // INTERVAL_ROWS))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((unit(matrix(batch)) @ axes[:, :GRID_AXES]) / epsilon).astype(np.int64) if batch.num_rows else np.zeros((0, len(grid)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(["class", "size", "vector"]).columns, *[pa.array(c) for c in cells.T]], names=["class", "size", "vector", *grid])

    grid = [f"c{i}" for i in range(min(GRID_AXES, size))]
    celled = classes.select("class", "size", "vector").mapInArrow(to_cells, "class long, size long, vector array<double>, " + ", ".join(f"{c} long" for c in grid))

    def to_interval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            whole = np.concatenate([matrix(b) for b in got])
            turned = unit(whole) @ axes[:, :BOX_AXES]
            column = lambda c: np.concatenate([b.column(c).to_numpy() for b in got]).tobytes()
            row = [TaskContext.get().partitionId(), column("class"), column("size"), whole.tobytes(), turned.min(0).tolist(), turned.max(0).tolist()]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["interval", "ids", "sizes", "vectors", "low", "high"])

    ordered = celled.repartitionByRange(parts, *grid, "class")
    intervals = steps.keep(ordered.mapInArrow(to_interval, "interval long, ids binary, sizes binary, vectors binary, low array<double>, high array<double>"), f"intervals{size}")
    per_group, many = max(1, GROUP_BYTES // (8 * size * INTERVAL_ROWS)), (intervals.agg(F.max("interval")).first()[0] or 0) + 1
    groups = max(-(-many // per_group), min(many, LEAST_GROUPS))
    grouped = intervals.withColumn("group", F.floor(F.col("interval") * groups / many).cast("int"))
    corner = lambda c, edge: F.array(*[edge(F.col(c)[k]) for k in range(min(BOX_AXES, size))]).alias(c)
    boxes = grouped.groupBy("group").agg(corner("low", F.min), corner("high", F.max))
    cells = _near_intervals(boxes.withColumnRenamed("group", "interval"), epsilon, size).select(F.col("interval").alias("i"), F.col("with").alias("j"))
    number = F.col("i") * groups + F.col("j")
    if groups * groups <= MOST_TASKS:  # a partition of its own for each cell
        number = F.get(F.array(*[F.lit(int(n)) for n in even_numbers(spark, groups * groups)]), number)
    cells = cells.withColumn("cell", number)
    held = cells.join(grouped, F.col("i") == F.col("group")).withColumn("side", F.lit(0))
    streamed = cells.where("i != j").join(grouped, F.col("j") == F.col("group")).withColumn("side", F.lit(1))
    work = held.unionByName(streamed).drop("group").repartition(min(MOST_TASKS, groups * groups), "cell").sortWithinPartitions("i", "j", "side", "interval")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(raw: dict) -> Interval:
            ids = np.frombuffer(raw["ids"], np.int64)
            return Interval(ids, np.frombuffer(raw["sizes"], np.int64), np.frombuffer(raw["vectors"], np.float64).reshape(len(ids), -1), axes, epsilon)

        cell, kept = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                raw = {c: batch.column(c)[r].as_py() for c in ("i", "j", "side", "ids", "sizes", "vectors", "low", "high")}
                if (raw["i"], raw["j"]) != cell:
                    cell, kept = (raw["i"], raw["j"]), []
                raw["box"] = tuple(np.array(raw[c][:BOX_AXES]) for c in ("low", "high"))
                if not raw["side"] and cell[0] != cell[1]:
                    kept.append(raw)
                    continue
                new = made(raw)
                partners = [p for p in kept if not distant(p["box"], raw["box"], epsilon)]
                for a in [*map(made, partners), *([new] if cell[0] == cell[1] else [])]:
                    counts, ids, u, v = join_intervals(a, new, cosine, epsilon)
                    linked = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[linked], u])), pa.array(np.concatenate([ids[linked], v])), pa.array(np.concatenate([counts[linked], np.zeros(len(u), np.int64)]))], names=["u", "v", "n"])
                if not raw["side"]:
                    kept.append(raw)

    return work.mapInArrow(run, "u long, v long, n long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept. Links: cosine of at least ``cosine``.

    Vectors that cannot be compared (see ``usable_vectors``) keep a row and link with nothing;
    vectors are compared within each length. Equal rows are one vector; different vectors of one
    id each have a row, with their own links. A null id keeps a row with null component and kept
    true. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    name = F.sha2(F.to_json(F.col("vector")), 256).alias("__class")
    members = steps.keep(usable_vectors(rows, key, vector).select("id", "vector", name).dropDuplicates(["id", "__class"]), "members")
    grouped = members.groupBy("__class").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    classes = steps.keep(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    all_ids = rows.select(F.col(f"`{key}`").cast("long").alias("id")).distinct()
    found = spark.createDataFrame([], "u long, v long, n long")
    for size, n in lengths_of(classes):
        found = found.unionByName(_found_links(classes.where(F.size("vector") == size), n, size, cosine, steps))
    found = steps.keep(found, "found")
    links = found.where("u = v").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("u != v").select("u", "v"))
    placed = classes.select("__class", "class", "first", "size").join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = placed.join(least, "component").join(links, "class", "left").select("__class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = members.select("id", "__class").join(per_class, "__class").select("id", "n_links", "component_id")
    return all_ids.join(linked, "id", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
