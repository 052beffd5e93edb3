"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The random features approximate a Gaussian kernel over a few statistics of the whole text.
Each partition sums its part of the normal equations; only matrices whose size depends on
the number of features, never on the rows, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.shared import ensure_checkpoint_dir, partition_sums

SAMPLE_ROWS = 20_000
FEATURES = 256
KERNEL_WIDTH = 4.0
RIDGE = 1e-3
CLIP = 5.0
BINS = 512
SEED = 20
THRESHOLD = 0.3
STATISTICS = 16

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _CALL, _SYMBOL, _REST = range(9)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[33:127] = _SYMBOL
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = _STOP
_CLASS[[ord(c) for c in "!?"]] = _CALL


def statistics(text: str) -> list[float]:
    """Statistics of a whole text that do not name its words; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=9).tolist()
    size, counts = len(raw), Counter(words)
    letters = max(1, kinds[_LOWER] + kinds[_UPPER])
    lines = [line for line in text.split("\n") if line.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n),
        size / n,
        len(counts) / n,
        np.log(n / len(counts)),
        same / n,
        counts.most_common(1)[0][1] / n,
        pairs / max(1, n - 1),
        kinds[_UPPER] / letters,
        kinds[_DIGIT] / size,
        kinds[_STOP] / n,
        min(3.0, kinds[_CALL] / n),
        min(5.0, kinds[_SYMBOL] / n),
        kinds[_REST] / size,
        len(lines) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, words)) / n,
    ]


def with_statistics(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``statistics``: array<double> of the text; null is empty."""
    schema = rows.select(*keep, F.lit(None).cast("array<double>").alias("statistics")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py() or "") for t in batch.column("__text")]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    return rows.select(*keep, F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS)


@dataclass
class Model:
    """A fitted scorer; all its arrays have sizes fixed by the parameters."""

    center: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def features(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.center) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([np.ones(len(z)), waves])

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(values), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x; the centre and level of each pool."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    return np.array([a / c for a, _, c in pools]), np.array([b / c for _, b, c in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``most`` labelled rows, taken by a hash of the id, none of them held out.

    Rows with a null id or label are not used. Of an id labelled twice the larger label counts.
    Without labelled rows every text scores 0.5.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    taken = usable.groupBy(key).agg(F.max(label).cast("double").alias("__y")).orderBy(F.xxhash64(key), key).limit(most)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__body")).join(F.broadcast(taken), key)
    sample = with_statistics(rows.select("__y", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4)).alias("__fold"), "__body"), ["__y", "__fold"], "__body").checkpoint()

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        values = _matrix(batch)
        return np.stack([np.r_[len(values), values.sum(0)], np.r_[0, (values**2).sum(0)]])

    sums = partition_sums(sample, (2, STATISTICS + 1), moments)
    n = max(1.0, sums[0, 0])
    center = sums[0, 1:] / n
    spread = np.sqrt(np.maximum(sums[1, 1:] / n - center**2, 0))
    random = np.random.default_rng(SEED)
    model = Model(center, np.where(spread > 1e-9, spread, 1.0), random.normal(0, 1 / KERNEL_WIDTH, (STATISTICS, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES))
    if not sums[0, 0]:
        model.levels = np.array([0.5, 0.5])
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(batch)), batch.column("__y").to_numpy()
        return np.column_stack([z.T @ z, z.T @ y])

    def solve(rows: DataFrame) -> np.ndarray:
        equations = partition_sums(rows, (FEATURES + 1, FEATURES + 2), normal)
        penalty = RIDGE * max(1.0, equations[0, 0]) * np.diag(np.r_[0, np.ones(FEATURES)]) / FEATURES
        return np.linalg.solve(equations[:, :-1] + penalty + 1e-9 * np.eye(FEATURES + 1), equations[:, -1])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(_matrix(batch)), batch.column("__y").to_numpy()
        bins = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(bins, w, BINS) for w in (np.ones(len(y)), y, raw)])

    model.weights = solve(sample.where("__fold != 0"))
    counts = partition_sums(sample.where("__fold = 0"), (3, BINS), histogram)
    full = counts[0] > 0
    if full.any():
        model.knots, model.levels = isotonic(counts[2, full] / counts[0, full], counts[1, full] / counts[0, full], counts[0, full])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated score of the whole text: 0 to 1. Null and empty texts get a score too.

    All other columns and all rows stay; a column named like ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("double").alias(out)).schema
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py() or "") for t in batch.column("__text")]).reshape(batch.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(model.score(values), pa.float64())], names=[*kept, out])

    return given.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of held-out rows are never read into the fit."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
