"""Whitens embeddings from an exact integer scatter matrix.

Entries become integers x = floor(64 c) + 1000000. A task subtracts the shift again and adds up the sums S and the
cross-products XᵀX of its rows in integers of any size; the tasks' figures meet as sums of decimals, whose number
depends on the dimensions and the tasks alone. n·XᵀX - SSᵀ is formed exactly and only then becomes floating point: no
cancellation, no order of addition changes the result. Its eigenvectors come from eigh and are polished in extended
precision, so small eigenvalues beside large ones stay right.

Products are exact in blocks: entries are split into digits of 20 bits and blocks into 4096 rows, so that a product
of two digits summed over a block stays below 2^53, where doubles are exact.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, empty vectors too; of
vectors of different lengths those of the most frequent length stay (of equally frequent ones, the longest);
rows without a vec_id and repeated rows count like others; an entry beyond the range of a long takes the end of the
range; eigenvalues that are zero beside the largest (a constant dimension, fewer rows than dimensions) whiten to 0.0 and
are left out of ``identity_error``, which is 0.0 if all are; equal eigenvalues come in any order; further columns
are left out; an empty table gives an empty one. A vector of any length is one row; the matrix of squared length
is held by the driver and each task. ``deviation`` is null where it exceeds a long, ``deviation_exact`` where it exceeds
38 digits.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import bound_batches, lean

#: x = floor(STEPS * c) + SHIFT
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 32
DIGIT_BITS, BLOCK_ROWS = 20, 4096
#: Rows of a batch that a task gives out.
ROWS_OUT = 16_384
#: Cross-products leave a task as digits of so many bits, which longs hold and decimals add up.
LIMB_BITS, LIMBS = 60, 4
#: An eigenvalue below this share of the largest is zero.
ZERO_SHARE = 1e-17
_LONG = 1 << 63


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vector: the rows that take part, entries as doubles."""
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def steps_of(column: pa.Array, dims: int) -> np.ndarray:
    """x - SHIFT of every entry, rows by dimensions, as longs."""
    entries = np.floor(np.asarray(column.flatten(), np.float64) * STEPS)
    low, high = -_LONG, _LONG - 1 - SHIFT
    whole = np.clip(entries, -(2.0**62), 2.0**62).astype(np.int64)
    whole[entries < -(2.0**62)] = [max(low, int(e)) for e in entries[entries < -(2.0**62)]]
    whole[entries > 2.0**62] = [min(high, int(e)) for e in entries[entries > 2.0**62]]
    return whole.reshape(-1, dims)


def _digits(values: np.ndarray) -> list[np.ndarray]:
    """Doubles d with values = sum of d[k] << (20 k); the last one carries the sign."""
    out, bound = [], max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
    while bound >= 1 << DIGIT_BITS:
        out.append((values & ((1 << DIGIT_BITS) - 1)).astype(np.float64))
        values, bound = values >> DIGIT_BITS, (bound >> DIGIT_BITS) + 1
    return [*out, values.astype(np.float64)]


def cross_products(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and products of columns, as Python integers."""
    dims = steps.shape[1]
    sums, cross = np.zeros(dims, object), np.zeros((dims, dims), object)
    for at in range(0, len(steps), BLOCK_ROWS):
        digits = _digits(steps[at : at + BLOCK_ROWS])
        for i, a in enumerate(digits):
            sums += a.sum(axis=0).astype(np.int64).astype(object) << (DIGIT_BITS * i)
            for j, b in enumerate(digits[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) << (DIGIT_BITS * (i + j))
                cross += product if i == j else product + product.T
    return sums, cross


def _limbs(values: np.ndarray) -> list[pa.Array]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(pa.array(values & ((1 << LIMB_BITS) - 1), pa.int64()))
        values = values >> LIMB_BITS
    return [*out, pa.array(values, pa.int64())]


@dataclass(frozen=True)
class Scatter:
    """n, the sums of x - SHIFT and n·XᵀX - SSᵀ, all exact."""

    n: int
    sums: list[int]
    scaled: np.ndarray


def exact_scatter(vectors: DataFrame, dims: int) -> Scatter:
    """The scatter of vectors (vec_id, vector), all of ``dims`` entries."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            s, c = cross_products(steps_of(batch.column(0), dims))
            n, sums, cross = n + batch.num_rows, sums + s, cross + c
        if n:
            # row -1 holds n in front and the sums
            rows, columns = np.concatenate([[-1], np.full(dims, -1), upper[0]]), np.concatenate([[-1], np.arange(dims), upper[1]])
            values = np.concatenate([np.array([n], object), sums, cross[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), *_limbs(values)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    # a task takes as many files as there are for each core, so the number of matrices follows the cluster
    cores = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    partial = vectors.select("vector").coalesce(cores).mapInArrow(lean(run), "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    total = partial.groupBy("i", "j").agg(*(F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)))
    n, sums, cross = 0, [0] * dims, np.zeros((dims, dims), object)
    for row in total.collect():  # one row for each pair of dimensions
        value = sum(int(row[f"l{k}"]) << (LIMB_BITS * k) for k in range(LIMBS))
        if row.j < 0:
            n = value
        elif row.i < 0:
            sums[row.j] = value
        else:
            cross[row.i, row.j] = cross[row.j, row.i] = value
    own = np.array(sums, object)
    return Scatter(n, sums, n * cross - np.outer(own, own))


def _extended(value: int, divisor: int) -> np.longdouble:
    """value / divisor to the precision of a long double."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    shift = max(0, 80 + divisor.bit_length() - value.bit_length())
    quotient = (value << shift) // divisor
    extra = max(0, quotient.bit_length() - 64)
    quotient, shift = quotient >> extra, shift - extra
    high, low = quotient >> 32, quotient & 0xFFFFFFFF
    return sign * np.ldexp(np.longdouble(high) * np.longdouble(1 << 32) + np.longdouble(low), -shift)


def decompose(scatter: Scatter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, its unit eigenvectors in columns, and the covariance itself."""
    covariance = np.array([[_extended(v, scatter.n**2) for v in row] for row in scatter.scaled], np.longdouble)
    values, vectors = np.linalg.eigh(covariance.astype(np.float64))
    vectors = vectors.astype(np.longdouble)
    for _ in range(3):  # each step squares the error of well separated vectors
        off = np.eye(len(vectors), dtype=np.longdouble) - vectors.T @ vectors
        turned = vectors.T @ covariance @ vectors
        values = np.diag(turned) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        noise = 2 * (np.abs(turned - np.diag(values)).max() + np.abs(values).max() * np.abs(off).max())
        apart = np.abs(gap) > noise
        vectors = vectors + vectors @ np.where(apart, (turned + values[None, :] * off) / np.where(apart, gap, 1), off / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order], covariance


def deviations(steps: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of every row: n² Σx² - 2n ΣxS + ΣS², in longs as far as they reach."""
    top, most, dims = max(abs(int(steps.min())), abs(int(steps.max()))), max(map(abs, sums)), steps.shape[1]
    if top * max(top, most) * dims < _LONG:
        squares, mixed = (steps * steps).sum(axis=1), steps @ np.array(sums, np.int64)
    else:
        whole = steps.astype(object)
        squares, mixed = (whole * whole).sum(axis=1), whole @ np.array(sums, object)
    rest = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares.tolist(), mixed.tolist())]


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of table (vec_id, embedding)."""
    bound_batches(table.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    vectors = usable_vectors(table)
    lengths = vectors.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return table.sparkSession.createDataFrame([], schema)
    dims = lengths.dims
    vectors = vectors.filter(F.size("vector") == dims)
    scatter = exact_scatter(vectors, dims)
    n, sums = scatter.n, scatter.sums
    values, axes, covariance = decompose(scatter)
    kept = min(components, dims)
    real = values[:kept] > ZERO_SHARE * max(values[0], 0)
    scale = np.where(real, 1 / np.sqrt(np.where(real, values[:kept], 1)), 0)
    turn = axes[:, :kept] * scale
    trace = np.trace(covariance)
    explained = np.where(real, values[:kept] / trace, 0).astype(np.float64) if real.any() else np.zeros(kept)
    lines = turn.astype(np.float64)
    held = lines[:, real].astype(np.longdouble)
    error = float(np.abs(held.T @ covariance @ held - np.eye(held.shape[1])).max()) if real.any() else 0.0
    means = np.array([s // n for s in sums], np.int64)
    rests = np.array([(s - n * (s // n)) / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT // kept or 1):
                part = batch.slice(at, ROWS_OUT // kept or 1)
                steps = steps_of(part.column(1), dims)
                exact = deviations(steps, n, sums)
                # an integer difference from the mean's whole part, then its rest: nothing is lost to a large mean
                whitened = (steps.astype(np.longdouble) - means.astype(np.longdouble) - rests).astype(np.float64) @ lines
                rows = np.repeat(np.arange(part.num_rows), kept)
                columns = [
                    part.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(len(rows), n)),
                    pa.array([d if d < _LONG else None for d in exact], pa.int64()).take(pa.array(rows)),
                    pa.array(whitened.reshape(-1)),
                    pa.array(np.tile(explained, part.num_rows)),
                    pa.array(np.full(len(rows), error)),
                    pa.array([decimal.Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0)).take(pa.array(rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return vectors.mapInArrow(run, schema)
