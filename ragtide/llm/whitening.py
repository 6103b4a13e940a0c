"""Embedding whitening by an incremental eigendecomposition.

Every distinct grid vector is one centred rank-one update of a spectrum (n, exact sums, eigenvalues,
eigenvectors of the scatter matrix) that a task carries; spectra of tasks are combined by successive
rank-one updates along a tree, so a stored spectrum also takes vectors that arrive later.  The merged
eigenvectors are a complete basis in which one pass over the distributed rows takes the Rayleigh-Ritz
matrix (centred on the exact mean), whose small eigenproblem gives the components to double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.llm import secular
from ragtide.llm.common import materialize, small_batches
from ragtide.llm.vectors import matrix, on_grid

LANES = 8  # chains of updates that a task carries side by side; numpy works on all of them at once
FAN = 8  # states merged by one task
BATCH = 4096  # rows of an Arrow batch: two MB at 64 dimensions
NO_VARIANCE = 1e-13  # share of the largest eigenvalue up to which a component counts as without variance
STATE = "slot long, state binary"


@dataclass
class Spectrum:
    """Scatter of ``n`` vectors around their mean: exact integer sums, eigenvalues ascending, eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def plain(self) -> tuple:
        """Without this class, as states are kept."""
        return self.n, self.sums, self.values, self.vectors


@dataclass
class Whitener:
    """Mean sums / n and the components (columns) with their eigenvalues, falling; ``trace`` of the whole covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, from exact integers."""
        ref, rest = self.split()
        return (x - ref) - rest / self.n

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Nearest integer vector to the mean, and sums - n * that vector."""
        ref = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(ref, dtype=np.int64), np.array([s - self.n * r for s, r in zip(self.sums, ref)], dtype=np.int64)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums over dimensions of (n * x - sums)^2."""
        ref, rest = self.split()
        far = x - ref
        most = (int(np.abs(far).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2**62:
            return pa.array(((far * self.n - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        off = far.astype(object) * self.n - rest.astype(object)
        return pa.array([int(v) for v in (off * off).sum(1)], pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components over the root of the eigenvalue; NaN where there is no variance."""
        with np.errstate(all="ignore"):
            return self.centred(x) @ self.components / np.where(self.varies(), np.sqrt(np.maximum(self.values, 0)), np.nan)

    def varies(self) -> np.ndarray:
        return self.values > NO_VARIANCE * max(self.values.max(initial=0.0), 0.0)


def spectra(x: DataFrame) -> DataFrame:
    """One ``Spectrum`` a task (as pickled bytes) of the rows' column ``x``; tasks without rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = None
        for batch in batches:
            rows = matrix(batch)
            if len(rows):
                lanes = lanes or _Lanes(rows[0])
                lanes.add(rows)
        if lanes:
            yield _state(TaskContext.get().partitionId(), lanes.spectrum().plain())

    return x.select("x").mapInArrow(run, STATE)


class _Lanes:
    """Chains of centred rank-one updates; row i of a batch goes to chain i mod LANES."""

    def __init__(self, ref: np.ndarray):
        k = len(ref)
        self.ref = ref.astype(np.int64)  # sums are kept against it, so that products stay in 64 bits
        self.n = np.zeros(LANES, dtype=np.int64)
        self.sums = np.zeros((LANES, k), dtype=np.int64)
        self.d, self.u = np.zeros((LANES, k)), np.tile(np.eye(k), (LANES, 1, 1))

    def add(self, rows: np.ndarray) -> None:
        rows = rows - self.ref
        for at in range(0, len(rows), LANES):
            x = np.zeros_like(self.sums)
            m = len(rows[at : at + LANES])
            x[:m] = rows[at : at + m]
            n = np.maximum(self.n, 1)
            away = x - self.sums / n[:, None]
            weight = np.where((np.arange(LANES) < m) & (self.n > 0), np.sqrt(self.n / (self.n + 1)), 0.0)
            self.d, self.u = secular.update(self.d, self.u, away * weight[:, None])
            self.n[:m] += 1
            self.sums[:m] += x[:m]

    def spectrum(self) -> Spectrum:
        ref = [int(r) for r in self.ref]
        return combined([Spectrum(int(n), [int(s) + int(n) * r for s, r in zip(sums, ref)], d, u)
                         for n, sums, d, u in zip(self.n, self.sums, self.d, self.u) if n])


def combined(parts: list[Spectrum]) -> Spectrum:
    """One spectrum of all vectors of ``parts``, by rank-one updates, pairs at a time."""
    while len(parts) > 1:
        half = len(parts) // 2
        left, right, rest = parts[:half], parts[half : 2 * half], parts[2 * half :]
        left, right = zip(*((a, b) if a.n >= b.n else (b, a) for a, b in zip(left, right)))
        link = np.array([[(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums)] for a, b in zip(left, right)], dtype=float)
        link *= np.array([np.sqrt(a.n * b.n / (a.n + b.n)) for a, b in zip(left, right)])[:, None]
        d, u = secular.merge(*(np.array([getattr(s, f) for s in side]) for side in (left, right) for f in ("values", "vectors")), link)
        parts = rest + [Spectrum(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums)], d[i], u[i]) for i, (a, b) in enumerate(zip(left, right))]
    return parts[0]


def merged(states: DataFrame, combine: Callable[[list], object]) -> object | None:
    """All states of a (slot, state) table in one: FAN at a time in tasks, level by level; None without rows.

    A state's size depends on the dimensions only, and so does what reaches the driver.
    """
    states = materialize(states)
    last = states.agg(F.max("slot")).first()[0]
    if last is None:
        return None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = combine([pickle.loads(s) for s in frame.sort_values("slot").state])
        return pd.DataFrame({"slot": [int(frame.slot.iloc[0]) // FAN], "state": [pickle.dumps(out)]})

    while True:
        states = states.groupBy(F.expr(f"slot div {FAN}")).applyInPandas(run, STATE)
        last //= FAN
        if not last:
            return pickle.loads(states.first().state)


def _state(slot: int, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([pickle.dumps(value)], pa.binary())], names=["slot", "state"])


def _sums(x: DataFrame, of: Callable[[np.ndarray], tuple]) -> tuple | None:
    """Sum over all rows of the arrays that ``of`` gives for a matrix of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch))
                total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            yield _state(TaskContext.get().partitionId(), total)

    return merged(x.select("x").mapInArrow(run, STATE), lambda parts: tuple(sum(p) for p in zip(*parts)))


def fit(x: DataFrame, components: int) -> Whitener | None:
    """Whitener of a table of distinct grid vectors ``x``; None if it is empty."""
    state = merged(spectra(x), lambda parts: combined([Spectrum(*p) for p in parts]).plain())
    if state is None:
        return None
    spectrum = Spectrum(*state)
    basis, _ = np.linalg.qr(spectrum.vectors)
    start = Whitener(spectrum.n, spectrum.sums, basis, np.ones(len(basis)), 1.0)

    def ritz(rows: np.ndarray) -> tuple:
        y = start.centred(rows) @ basis
        return (y.T @ y,)

    (gram,) = _sums(x, ritz)
    values, turn = np.linalg.eigh(gram / spectrum.n)
    order = np.argsort(-values, kind="stable")
    axes = (basis @ turn)[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    values = np.maximum(values[order], 0.0)
    return Whitener(spectrum.n, spectrum.sums, axes[:, :components], values[:components], float(values.sum()))


def identity_error(x: DataFrame, fitted: Whitener) -> float | None:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, over components that vary."""
    varies = fitted.varies()
    if not varies.any():
        return None

    def moments(rows: np.ndarray) -> tuple:
        w = fitted.whitened(rows)[:, varies]
        return w.sum(0), w.T @ w

    first, second = _sums(x, moments)
    mean = first / fitted.n
    return float(np.abs(second / fitted.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every vector: one row for each ``vec_id`` and component.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (distinct grid vectors), deviation
    (decimal(38,0), sum over dimensions of (n * x - sums)^2), whitened, explained, identity_error.  Which rows
    take no part is said in ``on_grid``; repeated rows and null ids stay, each on its own; an empty table gives no
    rows.  A component without variance (equal vectors, fewer vectors than dimensions) has null ``whitened``, and
    ``identity_error`` leaves it out (null if none varies); ``explained`` is 0 where the trace is 0.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, BATCH)
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    rows = on_grid(vectors, scale, shift)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialize(rows.select("x").distinct().repartition(tasks))  # small as rows are, each costs an update
    fitted = fit(distinct, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(distinct, fitted), len(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                x, each = matrix(batch), pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                    fitted.deviation(x).take(each), pa.array(fitted.whitened(x).ravel(), from_pandas=True), pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * k), pa.float64())], names=schema.names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)
