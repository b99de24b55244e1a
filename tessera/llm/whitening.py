"""Whitening of embeddings: a randomised range finder over all centred rows, with Rayleigh-Ritz components."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Entries become whole numbers on a grid: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Columns beyond the wanted components, power passes before the range is widened, and the seed of the first directions.
OVERSAMPLING, PASSES, SEED = 10, 4, 11
#: A component counts as found when its residual is below this share of its distance to the next eigenvalue.
RESIDUAL = 1e-12
#: Eigenvalues below this share of the largest are rounding.
ZERO = 1e-12
#: Entries of vectors that a task holds as numbers at a time.
ENTRIES = 1 << 20


class Fit(NamedTuple):
    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray


# --- rows -----------------------------------------------------------------------------------------------------------


def sound_rows(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there, not empty, and holds finite entries alone."""
    v = F.col(f"`{vector}`")
    return table.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as whole numbers (rows, width)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width) + SHIFT


def _parts(batches, width: int, *names: str):
    """(columns, grid) of slices of at most ENTRIES entries."""
    step = max(1, ENTRIES // width)
    for b in batches:
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            yield [part.column(n) for n in names], _grid(part.column("vector"), width)


def _cells(values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat, kind)], names=["cell", "value"])


def _summed(vectors: DataFrame, task, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over tasks of an array that each makes of its rows; the driver gets one array, of the size of `shape`."""
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else np.float64)
    for r in vectors.mapInArrow(task, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def _sum_grid(width: int):
    def task(batches):
        total = np.zeros(width, np.int64)
        for _, x in _parts(batches, width):
            total += x.sum(axis=0)
        yield _cells(total, pa.int64())

    return task


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact whole number n*x - S."""
    return (n * x - sums) / n


def _trace(width: int, n: int, sums: np.ndarray):
    def task(batches):
        total = 0.0
        for _, x in _parts(batches, width):
            total += float(np.square(centred(x, n, sums)).sum())
        yield _cells(np.array([total]), pa.float64())

    return task


def _power(width: int, n: int, sums: np.ndarray, q: np.ndarray):
    def task(batches):
        total = np.zeros(q.shape)
        for _, x in _parts(batches, width):
            c = centred(x, n, sums)
            total += c.T @ (c @ q)
        yield _cells(total, pa.float64())

    return task


# --- components -----------------------------------------------------------------------------------------------------


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of q (orthonormal columns), given V q: values by falling size, vectors, residual norms."""
    b = q.T @ vq
    values, w = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(values)[::-1]
    values, w = values[order], w[:, order]
    return values, q @ w, np.linalg.norm(vq @ w - (q @ w) * values, axis=0)


def found(values: np.ndarray, residuals: np.ndarray, k: int, full: bool) -> bool:
    """Whether the first k pairs are eigenpairs to double precision: residuals small against the gaps to the neighbours. The span of all
    dimensions holds every eigenvector."""
    if full:
        return True
    if len(values) <= k:
        return False
    gaps = -np.diff(values[: k + 1])
    near = np.minimum(gaps, np.concatenate(([np.inf], gaps[:-1])))
    return bool(np.all(residuals[:k] <= RESIDUAL * near))


def find_components(apply, width: int, k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The k first eigenvalues and unit eigenvectors of a covariance that is known by apply(q) = V q alone.

    The range is found from seeded random directions, more than wanted, by repeated power passes. If residuals are still too
    large after `passes`, the range gets twice as many directions, in the end all dimensions, where Rayleigh-Ritz is exact."""
    random = np.random.default_rng(seed)
    size = min(width, k + oversampling)
    q = np.linalg.qr(random.standard_normal((width, size)))[0]
    while True:
        for _ in range(1 if size == width else passes):
            vq = apply(q)
            values, vectors, residuals = ritz(q, vq)
            if found(values, residuals, k, size == width):
                return values[:k], vectors[:, :k]
            q = np.linalg.qr(vq)[0]
        grown = min(width, 2 * size)
        q = np.linalg.qr(np.concatenate([q, random.standard_normal((width, grown - size))], axis=1))[0]
        size = grown


def fit(vectors: DataFrame, width: int, n: int, k: int) -> Fit:
    """Sums, trace and components of all rows (column vector), in passes that bring back arrays of width x size numbers at most."""
    sums = _summed(vectors, _sum_grid(width), "long", (width,))
    trace = float(_summed(vectors, _trace(width, n, sums), "double", (1,))[0]) / n
    values, components = find_components(lambda q: _summed(vectors, _power(width, n, sums, q), "double", q.shape) / n, width, min(k, width))
    real = values > ZERO * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
    return Fit(n, sums, trace, values[real], components[:, real])


# --- whitening ------------------------------------------------------------------------------------------------------


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exactly; None where it is no long."""
    d = n * x - sums
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 63:
        return np.square(d).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in d.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _identity(width: int, f: Fit):
    """Sums of the whitened rows, and of their products."""

    def task(batches):
        k = len(f.values)
        total = np.zeros((k + 1, k))
        for _, x in _parts(batches, width):
            w = (centred(x, f.n, f.sums) @ f.components) / np.sqrt(f.values)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield _cells(total, pa.float64())

    return task


def _whiten(width: int, f: Fit, error: float, id_type: pa.DataType):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def task(batches):
        k = len(f.values)
        step = max(1, 20_000 // k)
        for (ids,), x in _parts(batches, width, "vec_id"):
            for lo in range(0, len(x), step):
                own = x[lo : lo + step]
                m = len(own)
                w = (centred(own, f.n, f.sums) @ f.components) / np.sqrt(f.values)
                row = np.repeat(np.arange(m), k)
                deviation = pa.array(exact_deviation(own, f.n, f.sums), pa.int64())
                columns = [
                    ids.slice(lo, m).cast(id_type).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), deviation.take(pa.array(row)),
                    pa.array(w.reshape(-1)), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def whiten(table: DataFrame, vector: str = "embedding", k: int = 32) -> DataFrame:
    """Every sound vector projected on the first k components and divided by their standard deviations: vec_id, component,
    n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped. Vectors must have one length; otherwise the most frequent one
    counts (of ties the longest), and rows of other lengths are dropped. Repeated rows and rows without vec_id count each. A component whose variance is
    zero, as with less rows than dimensions, is left out; one row, equal rows and an empty table give an empty result.
    A deviation that no long can hold is null. Other columns are not read. The driver and each task hold arrays of the vectors' length squared,
    never rows."""
    spark = table.sparkSession
    id_type = dict(table.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = sound_rows(table, vector).select("vec_id", F.col(f"`{vector}`").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, n = lengths[0]["width"], lengths[0]["n"]
    rows = rows.filter(F.size("vector") == width)
    vectors = rows.select("vector")
    f = fit(vectors, width, n, k)
    if not len(f.values):
        return spark.createDataFrame([], schema)
    sums = _summed(vectors, _identity(width, f), "double", (len(f.values) + 1, len(f.values)))
    mean = sums[0] / n
    error = float(np.abs(sums[1:] / n - np.outer(mean, mean) - np.eye(len(f.values))).max())
    return rows.mapInArrow(_whiten(width, f, error, to_arrow_type(rows.schema["vec_id"].dataType)), schema)
