"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir of the session; on one machine, where none is named, a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltwork-"))


class Steps:
    """Tables that an operator writes between its steps, in the shared folder of checkpoints.

    A written step has no lineage, and Spark deletes the shuffle files behind it when it is
    written. ``drop`` deletes steps that no later one reads; what a result still reads stays.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/steps-{uuid.uuid4().hex}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            rows.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{self.folder}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEAN)
            else:
                self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partition_sums(rows: DataFrame, shape: tuple[int, int], part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part``: summed inside each partition, then row by row of the matrix."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"])

    def merge(table: pa.Table) -> pa.Table:
        whole = np.sum([v for v in table.column("values").to_pylist()], axis=0)
        return pa.table({"i": table.column("i")[:1].combine_chunks(), "values": pa.array([whole], pa.list_(pa.float64()))})

    out = rows.mapInArrow(sums, "i long, values array<double>").groupBy("i").applyInArrow(merge, "i long, values array<double>").collect()
    result = np.zeros(shape)
    for r in out:
        result[r["i"]] = r["values"]
    return result


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of an edge list ``u``, ``v`` of longs.

    Alternates large-star and small-star steps until nothing changes; each step is a
    pre-aggregated minimum and an equi-join, so a hub is no single task's group. Lineage is
    cut at the checkpoint folder. Nodes without an edge to another node are not returned.
    """
    steps = Steps(edges.sparkSession)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = steps.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    before, after, turn = None, mark(now), 0
    while before != after:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        turn += 1
        now = steps.keep(small.where("u != v").distinct(), str(turn))
        steps.drop(str(turn - 1))
        before, after = after, mark(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest connected index of each of n nodes; ``label`` carries on earlier work."""
    label = np.arange(n) if label is None else label
    while len(u):
        a, b = label[u], label[v]
        keep = a != b
        u, v, a, b = u[keep], v[keep], a[keep], b[keep]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop
    return label


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` (array<double>) of all rows whose vectors can be compared.

    Left out: null ids and vectors, null, NaN or infinite components, zero and empty vectors.
    Vectors of any length and all rows of a repeated id stay.
    """
    given = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return given.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(~bad & F.exists("vector", lambda x: x != 0))


def lengths_of(usable: DataFrame) -> list[tuple[int, int]]:
    """Lengths of vectors and how many have each; only vectors of one length are compared."""
    return [(r["n"], r["count"]) for r in usable.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]


def matrix(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """A column of equally long, non-null arrays as a matrix of doubles."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(batch.num_rows, -1 if batch.num_rows else 0)


def pair_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added in component order, so equal rows give equal doubles."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def squeezed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: the texts compressed, so that joins and stores carry less; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [squeeze(t.as_py() or b"") for t in batch.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(packed, pa.binary())], names=[key, text])

    return rows.select(key, text).mapInArrow(run, rows.select(key, F.col(text).cast("binary").alias(text)).schema)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes, for texts that are stored between steps."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
