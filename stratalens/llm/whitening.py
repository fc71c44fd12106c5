"""Whitening of embeddings: distributed centred covariance, leading components, and the projection of every vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stratalens.llm.eigen import EPS, leading_pairs
from stratalens.llm.text import only

#: Entries are held within this bound, up to which every integer is a double.
BOUND = 1 << 53
#: Vectors multiplied or projected at a time.
BLOCK = 2048
#: Longest vectors accepted: the driver holds a few square matrices of this size.
MAX_DIM = 8192


@dataclass(frozen=True)
class Model:
    """What a projection needs; its size depends on the vectors' length alone."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray  # one unit vector a column

    @property
    def pivot(self) -> list[int]:
        """The nearest whole number to each mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums] if self.n else []

    @property
    def offset(self) -> np.ndarray:
        """Mean minus pivot, at most a half, to full precision."""
        return np.array([(s - self.n * p) / self.n for s, p in zip(self.sums, self.pivot)])

    @property
    def sound(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding: only by those can be divided."""
        largest = self.values.max(initial=0.0)
        return (self.values > max(len(self.sums), 1) * 16 * EPS * largest) & (self.values > 0.0)


def whole_vectors(column: pa.Array, scale: int, shift: int, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors ``floor(scale * entry) + shift`` of rows of one length at a time.

    Vectors that are null, empty, or hold a null or an entry that is not finite are passed over; so are those of
    another length than ``dim``, if it is given.
    """
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    for length in sorted(set(lengths.tolist())):
        if length < 1 or (dim is not None and length != dim):
            continue
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            flat = column.take(pa.array(some)).flatten()
            entries = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
            entries = entries.reshape(len(some), length)  # null entries became NaN
            fine = np.isfinite(entries).all(axis=1)
            with np.errstate(over="ignore"):
                moved = np.floor(entries[fine] * scale) + shift
            yield some[fine], np.clip(moved, -BOUND, BOUND).astype(np.int64)


def _partial_matrices(vectors: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum over all vectors of the outer products of ``rows_of(batch)``: every task sums its own blocks, and the
    tasks' rows are added up line by line, in the order of the tasks, so that a repeated task gives the same sum."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for block in rows_of(batch):
                total += block.T @ block
                seen = True
        if seen:
            task = TaskContext.get().partitionId()
            flat = pa.ListArray.from_arrays(np.arange(0, width * width + 1, width, dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, task, np.int32)), flat], ["line", "task", "entries"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, total = None, None
        for batch in batches:
            entries = batch.column("entries").flatten().to_numpy().reshape(-1, width)
            for number, row in zip(batch.column("line").to_pylist(), entries):
                if number != line:
                    if line is not None:
                        yield _line(line, total)
                    line, total = number, np.zeros(width)
                total = total + row
        if line is not None:
            yield _line(line, total)

    parts = vectors.mapInArrow(multiply, "line int, task int, entries array<double>")
    sums = parts.repartition("line").sortWithinPartitions("line", "task").mapInArrow(add, "line int, entries array<double>")
    matrix = np.zeros((width, width))
    for row in sums.collect():  # one row a dimension
        matrix[row["line"]] = row["entries"]
    return matrix


def _line(number: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["line", "entries"])


def _sums(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length (the longer one of equals) and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        high: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column("vector"), scale, shift):
                if len(x):
                    dim = x.shape[1]
                    counts[dim] = counts.get(dim, 0) + len(x)
                    high[dim] = high.get(dim, 0) + (x >> 24).sum(axis=0)
                    low[dim] = low.get(dim, 0) + (x & 0xFFFFFF).sum(axis=0)
        for dim, n in counts.items():
            numbers = np.arange(dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim, np.int32)), pa.array(numbers), pa.array(np.full(dim, n)), pa.array(high[dim]), pa.array(low[dim])],
                ["dim", "entry", "n", "high", "low"],
            )

    parts = vectors.mapInArrow(run, "dim int, entry int, n bigint, high bigint, low bigint")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    added = parts.groupBy("dim", "entry").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low"))
    # One number a length is compared before the sums of one length come to the driver.
    known = added.where("entry = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim", "n").first()
    if known is None:
        return 0, []
    if known["dim"] > MAX_DIM:
        raise ValueError(f"vectors of {known['dim']} entries; at most {MAX_DIM} are whitened")
    rows = added.where(F.col("dim") == known["dim"]).collect()
    sums = {r["entry"]: (int(r["high"]) << 24) + int(r["low"]) for r in rows}
    return known["n"], [sums[i] for i in range(known["dim"])]


def fit(rows: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vector_col: str = "embedding") -> Model:
    """Mean, covariance (divisor n) and leading eigenpairs of all usable vectors of ``rows``.

    Two passes over the vector column: exact integer sums, then the products of centred vectors. Each task
    sends one row a dimension. The driver gets one square matrix and finds the eigenpairs by
    :func:`stratalens.llm.eigen.leading_pairs`.
    """
    vectors = only(rows, vector=vector_col)
    n, sums = _sums(vectors, scale, shift)
    model = Model(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    if not n:
        return model
    pivot, offset = np.array(model.pivot, dtype=np.int64), model.offset

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in whole_vectors(batch.column("vector"), scale, shift, len(pivot)):
            yield (x - pivot) - offset

    covariance = _partial_matrices(vectors, centred, len(sums)) / n
    values, found = leading_pairs(covariance, components)
    return Model(n, sums, float(np.trace(covariance)), values, found)


def _projected(model: Model):
    pivot, offset = np.array(model.pivot, dtype=np.int64), model.offset
    with np.errstate(divide="ignore", invalid="ignore"):
        turned = np.where(model.sound, model.components / np.sqrt(np.abs(model.values)), np.nan)
    return lambda x: ((x - pivot) - offset) @ turned


def identity_error(rows: DataFrame, model: Model, scale: int = 64, shift: int = 1_000_000, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them;
    None without a component to divide by."""
    sound = np.flatnonzero(model.sound)
    if not len(sound):
        return None
    project, dim, width = _projected(model), len(model.sums), len(sound)
    vectors = only(rows, vector=vector_col)

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in whole_vectors(batch.column("vector"), scale, shift, dim):
            yield project(x)[:, sound]  # the mean is taken off before projecting

    covariance = _partial_matrices(vectors, centred, width) / model.n
    return float(np.abs(covariance - np.eye(width)).max())


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sum of ``(n * x - S)`` squared of each row; None beyond 64 bits."""
    pivot = np.array(model.pivot, dtype=np.int64)
    rest = [s - model.n * p for s, p in zip(model.sums, model.pivot)]  # at most n / 2 each
    moved = x - pivot
    most = model.n * (int(np.abs(moved).max(initial=0)) + 1)
    if most * most * max(len(rest), 1) < 1 << 63:
        y = moved * model.n - np.array(rest, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((model.n * a - b) ** 2 for a, b in zip(row, rest)) for row in moved.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(rows: DataFrame, model: Model, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened`` of every usable vector: its exact squared distance from the mean, times
    n squared, and its projections on the components over the square roots of their eigenvalues.

    Vectors are made of whole numbers ``floor(scale * entry) + shift`` first, held within 2^53. The model goes to the
    tasks with the function; its size is the vectors' length times the number of components. No shuffle.

    Edge cases: vectors that are null, empty or hold a null or an entry that is not finite have no row; neither have those of another
    length than the most frequent one (the longer one of equals). Repeated rows count and return each; a null id is carried along. A
    component whose eigenvalue is only rounding (all vectors equal, fewer vectors than components) gives null; a deviation beyond 64 bits is null. Empty tables
    give empty results; other columns are ignored.
    """
    base = only(rows, vec_id=id_col, vector=vector_col)
    kind = base.schema["vec_id"].dataType.simpleString()
    project, dim, width = _projected(model), len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.n:
                continue
            for places, x in whole_vectors(batch.column("vector"), scale, shift, dim):
                if not len(x):
                    continue
                flat = pa.array(project(x).ravel(), from_pandas=True)  # NaN to null
                ends = np.arange(0, len(x) * width + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(places)), pa.array(_deviations(x, model), pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                    ["vec_id", "deviation", "whitened"],
                )

    return base.mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>")
