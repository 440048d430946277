"""Whitening of embeddings by shifted CholeskyQR.

The distinct vectors are the fit list.  A pass sums, in every task, the Gram matrix of
the centred rows; a shift keeps its Cholesky factor R1 defined.  The next pass solves
each row against R1, which leaves rows that are nearly orthonormal, and takes their
Gram matrix; passes go on until it is the identity.  The product R of all factors is
the triangular factor of the centred rows, to working precision however badly the
first Gram matrix was conditioned, and the singular value decomposition of R gives
the components.  The driver holds matrices of the vectors' width only, summed by a
shuffle of one matrix a task; the rows stay where they are.

Rank: directions without variance are no components; a table whose distinct vectors
span fewer than COMPONENTS dimensions has fewer components, and one distinct vector
has none (no rows).  Rows whose vector is null or not finite go.  Shorter vectors are
filled with zeros, entries beyond 2 ** 25 are held there.  Null and repeated vec_ids
are kept row by row.  A deviation beyond a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.vectors import matrix, whole_vectors
from keystead.session import stage

SCALE = 256
COMPONENTS = 4
PASSES = 10  # Gram passes at most; three are the rule
CLOSE = 1e-12  # the Gram matrix is the identity
FLAT = 1e-12  # share of the variance below which a direction has none
ROUNDING = float(np.finfo(np.float64).eps)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows times the inverse of an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def shifted_cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of gram + shift; the shift grows until there is one."""
    floor = 100 * len(gram) * ROUNDING * max(float(np.trace(gram)), ROUNDING)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, floor)


@dataclass
class Whitening:
    """What a fit list gives: its size and sums, and one direction a component."""

    n: int
    sums: list[int]
    directions: np.ndarray  # width x components, unit columns
    variances: np.ndarray
    total: float  # trace of the covariance
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.directions) / np.sqrt(self.variances)


def fit_list(vectors: DataFrame) -> DataFrame:
    """The distinct vectors; copies are folded in each task before they move."""
    return stage(vectors.select("x").distinct(), "fit")


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += matrix(batch.column(0), width).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"j": np.arange(width + 1), "v": np.append(sums, n)})

    found = fit.mapInArrow(work, "j long, v long").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    values = {r["j"]: int(r["v"]) for r in found}  # one row a dimension
    return values.get(width, 0), [values.get(j, 0) for j in range(width)]


def gram(fit: DataFrame, width: int, rows_of) -> np.ndarray:
    """The sum over all vectors of y'y, y = rows_of(vectors); a task sends one matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            y = rows_of(matrix(batch.column(0), width).astype(np.float64))
            own = y.T @ y if own is None else own + y.T @ y
        if own is not None:
            i, j = np.triu_indices(len(own))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int64), "j": j.astype(np.int64), "v": own[i, j]})

    cells = fit.mapInArrow(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))  # one row a cell of the matrix
    size = int(j.max()) + 1
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = v
    return out


def whitening(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of a table (x); None if its distinct vectors don't vary."""
    fit = fit_list(vectors)
    n, sums = totals(fit, width)
    if n < 2:
        return None
    mean = np.array([s / n for s in sums])
    first = gram(fit, width, lambda x: x - mean)
    total = float(np.trace(first))
    if not total:
        return None
    # the directions that vary; all of them unless entries depend on each other
    values, basis = np.linalg.eigh(first)
    varies = values > FLAT * total
    base = np.eye(width) if varies.all() else basis[:, varies]
    centred = lambda x: (x - mean) @ base  # noqa: E731 - goes to the tasks with its values
    own = first if varies.all() else gram(fit, width, centred)
    factors = [shifted_cholesky(own, 100 * width * ROUNDING * total)]
    passes = 1
    while passes < PASSES:
        known = list(factors)

        def orthogonal(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            for factor in known:
                y = solved(y, factor)
            return y

        own = gram(fit, width, orthogonal)
        passes += 1
        if np.abs(own - np.eye(len(own))).max() <= CLOSE:
            break
        factors.append(shifted_cholesky(own, 0.0))
    whole = factors[0]
    for factor in factors[1:]:
        whole = factor @ whole
    _, size, across = np.linalg.svd(whole)
    keep = min(components, len(size))
    found = Whitening(n, sums, base @ across[:keep].T, size[:keep] ** 2 / n, total / n, passes)
    spread = gram(fit, width, lambda x: np.hstack((found.whitened(x), np.ones((len(x), 1)))))
    middle = spread[:keep, keep] / n
    found.identity_error = float(np.abs(spread[:keep, :keep] / n - np.outer(middle, middle) - np.eye(keep)).max())
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over the entries of (n * x - S) ** 2, exact; null beyond a long."""
    widest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if x.shape[1] * widest * widest < 1 << 63:
        far = n * x - np.array(sums, dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    far = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]


KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row and component."""
    vectors, width = whole_vectors(table, SCALE)
    model = whitening(vectors, width, components)
    if model is None:
        return table.sparkSession.createDataFrame([], KIND)
    names = [part.split()[0] for part in KIND.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            x, rows = matrix(batch.column(1), width), batch.num_rows
            far = deviations(x, model.n, model.sums)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)), pa.array([v for v in far for _ in range(k)], pa.int64()),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.variances / model.total, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select("vec_id", "x").mapInArrow(work, KIND)
