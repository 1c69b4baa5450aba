"""Embedding whitening by Chebyshev-filtered subspace iteration.

The components are the leading eigenvectors of the covariance V of integer vectors
x = floor(1024 c) + 100000.  V is never formed: a block of ``WIDTH`` vectors Q is improved by
passes over the rows, each a distributed sum of (x - mean)' ((x - mean) Q) / n.

1. *Filter.*  The Chebyshev recurrence of ``DEGREE`` terms, one pass a term, stays within
   [-1, 1] on the unwanted spectrum [0, least Ritz value of the block] and grows fast above.
2. *QR and Rayleigh-Ritz.*  The filtered block is made orthonormal; one pass gives V Q, the
   Ritz pairs and the residuals |V q - e q| of the wanted ones.  The same pass is the first
   term of the next filter.
3. *Certificate.*  Iteration ends when every wanted residual is below ``TOLERANCE`` times the
   largest Ritz value, or rounding keeps the residuals from falling any further and they
   are below ``ACCEPTED``.  A block as wide as the vectors is exact at once.

The rows are staged once as matrix blocks (one binary value for up to ``BLOCK_BYTES``), read by
every pass; a pass sums its products per task, then over groups of tasks, and at most
``GATHER`` partial sums of WIDTH x dimensions doubles reach the driver.  Sums and deviations
are integers and exact.

Edge cases: vectors that are null or empty or hold null, NaN, infinite entries, or entries
whose x leaves +-2**52, take no part; nor do vectors whose length is not the most
common one (ties: the longer).  Repeated rows and null ids all count.  Components of no
variance (constant or dependent dimensions, a single row) are left out, so there may be
fewer than asked for; with none of them, or an empty table, there are no rows.  A
deviation beyond a long is a decimal here and null as a long.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.session import materialize

SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 52)
#: vectors iterated beside the wanted ones make the filter converge faster
GUARD = 24
DEGREE = 10
TOLERANCE = 2.0 ** -46
#: what a block that no longer improves must have reached
ACCEPTED = 1e-9
SEED = 42
BLOCK_BYTES = 1 << 18
CHUNK = 8192
GATHER = 64


# --- integer vectors -----------------------------------------------------------------------


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(the rows whose vectors take part, their number of dimensions)."""
    v = F.col(column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < (LIMIT - SHIFT) / SCALE))
    good = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    sizes = good.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return (good if common is None else good.where(F.size(v) == common)), common or 0


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(values * SCALE) + SHIFT).astype(np.int64).reshape(-1, dims)


def _blocks(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """The integer vectors as matrix blocks."""
    rows = max(1, BLOCK_BYTES // (8 * dims))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + rows].tobytes() for i in range(0, len(x), rows)], pa.binary())], ["x"])

    return vectors.select(column).mapInArrow(pack, "x binary")


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for value in b.column(0):
            yield np.frombuffer(value.as_buffer(), np.int64).reshape(-1, dims)


# --- sums over all rows --------------------------------------------------------------------


def _total(parts: DataFrame, shape: tuple[int, ...], tasks: int) -> np.ndarray:
    """The sum of the ``part`` matrices, one a task: groups of tasks first where there are
    many, so that at most ``GATHER`` come here."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for value in b.column(0):
                total += np.frombuffer(value.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    while tasks > GATHER:
        tasks = max(GATHER, tasks // GATHER)
        parts = parts.repartition(tasks).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r.part, np.float64).reshape(shape) for r in parts.collect()], axis=0)


def _summed(blocks: DataFrame, dims: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(block)`` over all matrix blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _matrices(batches, dims):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _total(blocks.mapInArrow(run, "part binary"), shape, blocks.rdd.getNumPartitions())


def exact_sums(blocks: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """n, and the exact sums of x and of x**2 for each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, [0] * dims, [0] * dims
        for x in _matrices(batches, dims):
            top = int(np.abs(x).max(initial=0))
            wide = x if top * top * max(len(x), 1) < 1 << 62 else x.astype(object)
            n += len(x)
            s = [a + int(b) for a, b in zip(s, wide.sum(axis=0))]
            q = [a + int(b) for a, b in zip(q, (wide * wide).sum(axis=0))]
        cols = [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(v) for v in s]), pa.array([str(v) for v in q])]
        yield pa.RecordBatch.from_arrays(cols, ["dim", "n", "s", "q"])

    parts = blocks.mapInArrow(run, "dim int, n long, s string, q string")
    # squares of numbers up to 2**52 pass 38 digits in a sum, so they are added in two halves
    low, cut = F.expr("cast(right(q, 18) as decimal(38,0))"), F.expr("cast(if(length(q) > 18, left(q, length(q) - 18), '0') as decimal(38,0))")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
                                    F.sum(low).alias("low"), F.sum(cut).alias("high")).orderBy("dim").collect()
    return rows[0].n, [int(r.s) for r in rows], [int(r.high) * 10**18 + int(r.low) for r in rows]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with the difference n*x - S taken in integers."""
    return (_scaled(x, n, sums) / n).astype(np.float64)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    top = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in sums)
    return n * x - sums.astype(np.int64) if top < 1 << 62 else n * x.astype(object) - sums


# --- eigenvectors --------------------------------------------------------------------------


def leading(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, degree: int = DEGREE, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest residual over the largest
    eigenvalue) of the positive semidefinite operator ``apply``."""
    width = min(dims, k + guard)
    k = min(k, dims)
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, width)))
    best = math.inf
    while True:
        vq = apply(q)                                       # Rayleigh-Ritz
        small = q.T @ vq
        e, z = np.linalg.eigh((small + small.T) / 2)
        e, z = e[::-1], z[:, ::-1]
        q, vq = q @ z, vq @ z
        top = max(float(e[0]), 0.0)
        off = np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max() / top if top > 0 else 0.0
        if off <= TOLERANCE or width == dims or (off <= ACCEPTED and off > best / 2):
            return e[:k], q[:, :k], float(off)
        best = min(best, off)
        edge = max(float(e[-1]), top * 1e-12)
        q = _filtered(apply, q, vq, edge, top, _terms(edge, top, max(float(e[k - 1]), edge), degree))


def _terms(edge: float, top: float, least: float, degree: int) -> int:
    """Terms of the filter: ``degree``, or fewer where the largest eigenvalue would outgrow the
    least wanted one so far that rounding swallows it."""
    apart = math.acosh(2 * top / edge - 1) - math.acosh(2 * least / edge - 1)
    return max(2, min(degree, int(23 / apart))) if apart > 0 else degree


def _filtered(apply, q: np.ndarray, vq: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` on [0, edge], scaled to about 1 at ``top``."""
    half = edge / 2
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    q, _ = np.linalg.qr(now)
    return q


# --- the operator --------------------------------------------------------------------------

OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, keep: list[str], column: str = "embedding", k: int = 8) -> DataFrame:
    """One row per vector and component: the columns ``keep``, component (from 1), n,
    deviation (sum over dimensions of (n x - S)**2), whitened, explained, identity_error
    (largest entry of the whitened covariance minus the identity) and residual (the
    certificate of the eigenvectors)."""
    spark = vectors.sparkSession
    good, dims = usable(vectors.select(*keep, F.col(column).alias("_v")), "_v")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keep).schema.fields), OUT])
    if not dims:
        return spark.createDataFrame([], schema)
    blocks = materialize(_blocks(good, "_v", dims))
    n, s, sq = exact_sums(blocks, dims)
    sums = np.array(s, dtype=object)
    trace = sum(n * b - a * a for a, b in zip(s, sq)) / (n * n)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(blocks, dims, q.shape, part) / n

    e, u, residual = leading(apply, dims, k)
    real = e > trace * dims * 2.0 ** -50
    e, u = e[real], u[:, real]
    if not len(e):
        return spark.createDataFrame([], schema)
    to_white = u / np.sqrt(e)
    width = len(e)
    mean = _summed(blocks, dims, (width,), lambda x: (_centred(x, n, sums) @ to_white).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ to_white - mean
        return w.T @ w

    error = float(np.abs(_summed(blocks, dims, (width, width), spread) / n - np.eye(width)).max())
    explained = e / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                x = _integers(b.column("_v"), dims)
                scaled = _scaled(x, n, sums)
                far = max(abs(int(scaled.max(initial=0))), abs(int(scaled.min(initial=0))))
                wide = scaled if far * far * dims < 1 << 63 else scaled.astype(object)
                white = (scaled / n).astype(np.float64) @ to_white
                rows, again = len(x), np.repeat(np.arange(len(x)), width)
                deviation = [str(v) for v in (wide * wide).sum(axis=1)]
                cols = [b.column(c).take(pa.array(again)) for c in keep]
                cols += [pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)), pa.array(np.full(rows * width, n, np.int64)),
                         pa.array(deviation).take(pa.array(again)), pa.array(white.ravel()), pa.array(np.tile(explained, rows)),
                         pa.array(np.full(rows * width, error)), pa.array(np.full(rows * width, residual))]
                names = [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]
                yield pa.RecordBatch.from_arrays(cols, names)

    made = good.mapInArrow(project, schema.replace("deviation decimal(38,0)", "deviation string"))
    return made.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def deviation_long() -> Column:
    """The exact deviation as a long; null where it is beyond one."""
    return F.expr("try_cast(deviation as bigint)")
