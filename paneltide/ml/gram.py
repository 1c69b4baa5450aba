"""Linear, ridge and lasso configurations from one Gram matrix.

One aggregate gives every column's training mean and range, one pass the centred sums
Z'Z, Z'y, y'y (missing values stand at the mean, so they add nothing).  A scaler only divides
columns, a feature group only picks rows and columns of Z'Z, a penalty only changes the
solve; so any number of configurations of these families is solved without another pass over
the rows.  Solving is spread over tasks by configuration; what reaches the driver is one
coefficient vector for each.  Scores of all configurations are one product of the rows with the
coefficient matrix; where a task can hold the rows of a group, it ranks them as well, and
only the rank measures leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scaling

KINDS = ("linear", "ridge", "lasso")
#: partial sums that the driver adds up itself; more are added by tasks first
GATHER = 64
LASSO_SWEEPS, LASSO_TOLERANCE = 10_000, 1e-12


def matrix_sum(df: DataFrame, shape: tuple[int, ...], part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``part(batch)`` over all rows: one matrix a task, added in groups of tasks
    until at most ``GATHER`` are left for the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for value in b.column(0):
                total += np.frombuffer(value.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    tasks, parts = df.rdd.getNumPartitions(), df.mapInArrow(run, "part binary")
    while tasks > GATHER:
        tasks = max(GATHER, tasks // GATHER)
        parts = parts.repartition(tasks).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r.part, np.float64).reshape(shape) for r in parts.collect()], axis=0)


def vectors(cols: list[str], name: str = "x") -> F.Column:
    return F.array(*[F.col(c).cast("double") for c in cols]).alias(name)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A (rows, width) float matrix of an array column, NaN for nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass(frozen=True)
class Gram:
    """Centred sums of the training rows, and what each scaler divides a column by."""

    cols: list[str]
    n: int
    means: np.ndarray
    y_mean: float
    zz: np.ndarray
    zy: np.ndarray
    scales: dict[str, np.ndarray]

    def solve(self, cols: list[str], kind: str, alpha: float, scaler: str) -> tuple[np.ndarray, float]:
        """(coefficients on the unscaled columns of the whole Gram, intercept)."""
        if not cols:
            raise ValueError("no feature columns")
        at = [self.cols.index(c) for c in cols]
        k = self.scales[scaler][at]
        g, r = self.zz[np.ix_(at, at)] / np.outer(k, k), self.zy[at] / k
        if kind == "linear":
            w = np.linalg.lstsq(g, r, rcond=None)[0]
        elif kind == "ridge":                           # |y - Xw|^2 + alpha |w|^2
            w = np.linalg.solve(g + alpha * np.eye(len(at)), r)
        elif kind == "lasso":                           # |y - Xw|^2 / 2n + alpha |w|_1
            w = _lasso(g / self.n, r / self.n, alpha)
        else:
            raise ValueError(f"model type must be one of {KINDS}, not {kind!r}")
        out = np.zeros(len(self.cols))
        out[at] = w / k
        return out, float(self.y_mean - out @ self.means)


def _lasso(g: np.ndarray, r: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent on the Gram matrix until no coefficient moves."""
    w, gw = np.zeros(len(r)), np.zeros(len(r))
    for _ in range(LASSO_SWEEPS):
        moved = 0.0
        for j in range(len(r)):
            if g[j, j] <= 0:
                continue
            rho = r[j] - gw[j] + g[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / g[j, j]
            if new != w[j]:
                gw += g[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(g[j, j]))
                w[j] = new
        if moved <= LASSO_TOLERANCE:
            break
    return w


def collect(train: DataFrame, cols: list[str], label: str) -> Gram:
    """The Gram of the rows of ``train`` (staged: read three times) with a label."""
    train = train.where(F.col(label).isNotNull())
    found = scaling.fit_means(train, cols)
    means = {c: 0.0 if v is None else float(v) for c, v in found.items()}
    y = train.agg(F.avg(label).alias("y"), F.count(label).alias("n")).first()
    if not y.n:
        raise ValueError("no training rows")
    d, mu = len(cols), np.array([means[c] for c in cols])

    def part(b: pa.RecordBatch) -> np.ndarray:
        z = np.empty((b.num_rows, d + 1))
        z[:, :d] = np.nan_to_num(matrix(b.column("x"), d) - mu)
        z[:, d] = b.column("y").to_numpy(zero_copy_only=False).astype(float) - y.y
        return z.T @ z

    total = matrix_sum(train.select(vectors(cols), F.col(label).cast("double").alias("y")), (d + 1, d + 1), part)
    filled = scaling.apply_fill(train, means)
    spread = np.sqrt(np.maximum(np.diag(total)[:d], 0) / y.n)
    scales = {"none": np.ones(d), "standard": np.where(spread > 0, spread, 1.0)}
    for kind in ("minmax", "robust"):
        fitted = scaling.fit_scaler(filled, cols, kind)
        scales[kind] = np.array([float(fitted[c][1]) for c in cols])
    return Gram(list(cols), y.n, mu, float(y.y), total[:d, :d], total[:d, d], scales)


SOLVED = "iteration int, weights array<double>, intercept double, error string"


def solve_all(spark: SparkSession, gram: Gram, configs: list[tuple[int, list[str], str, float, str]],
              tasks: int) -> tuple[dict[int, tuple[np.ndarray, float]], dict[int, str]]:
    """({iteration: (weights, intercept)}, {iteration: error}) of ``configs``: (iteration, columns,
    kind, alpha, scaler).  Both grow with the number of configurations only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in b.to_pylist():
                try:
                    w, intercept = gram.solve(c["cols"], c["kind"], c["alpha"], c["scaler"])
                    rows.append((c["iteration"], w.tolist(), intercept, None))
                except (ValueError, np.linalg.LinAlgError) as e:
                    rows.append((c["iteration"], None, None, str(e)))
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["iteration", "weights", "intercept", "error"])

    jobs = spark.createDataFrame(configs, "iteration int, cols array<string>, kind string, alpha double, scaler string")
    rows = jobs.repartition(max(1, min(tasks, len(configs)))).mapInArrow(run, SOLVED).collect()
    return ({r.iteration: (np.array(r.weights), r.intercept) for r in rows if r.error is None},
            {r.iteration: r.error for r in rows if r.error is not None})


def score_all(rows: DataFrame, gram: Gram, solved: dict[int, tuple[np.ndarray, float]], keep: list[str]) -> DataFrame:
    """iteration, the columns ``keep`` and score: every row under every solved configuration."""
    ids = np.array(sorted(solved), np.int32)
    weights = np.stack([solved[i][0] for i in ids], 1)
    intercepts = np.array([solved[i][1] for i in ids]) + gram.means @ weights
    d, mu = len(gram.cols), gram.means
    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join(["iteration int", *(f"{f.name} {f.dataType.simpleString()}" for f in fields), "score double"])
    step = max(1, (1 << 20) // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                made = np.nan_to_num(matrix(b.column("x"), d) - mu) @ weights + intercepts
                again = pa.array(np.repeat(np.arange(b.num_rows), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, b.num_rows)), *(b.column(f.name).take(again) for f in fields),
                                                  pa.array(made.ravel())], ["iteration", *(f.name for f in fields), "score"])

    return rows.select(vectors(gram.cols), *[f.name for f in fields]).mapInArrow(run, schema)


#: rank measures of a configuration on a group of rows, or why there are none
MEASURED = "iteration int, part string, grp int, exact double, within1 double, within2 double, error string"
#: the group of rows without one, inside tasks
NO_GROUP = -(1 << 31)


def groups_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_GROUP).to_numpy(zero_copy_only=False)


def rank_measures(score: np.ndarray, true_rank: np.ndarray) -> tuple[float, float, float]:
    """Shares of rows whose descending min-rank by score is the true one, within one, within two
    (``operators.rank`` and ``operators.metrics`` on one group).  NaN ranks first, as in Spark."""
    down = np.where(np.isnan(score), -np.inf, -score)
    order = np.lexsort((~np.isnan(score), down)) if np.isnan(score).any() else np.argsort(down)
    down, lost = down[order], np.isnan(score)[order]
    new = np.r_[True, (down[1:] != down[:-1]) | (lost[1:] != lost[:-1])]
    rank = np.maximum.accumulate(np.where(new, np.arange(len(down)), 0)) + 1
    off = np.abs(rank - true_rank[order])
    return tuple(float(np.count_nonzero(off <= k) / len(off)) for k in range(3))


def measure_all(rows: DataFrame, part: str, gram: Gram, solved: dict[int, tuple[np.ndarray, float]], groups: int) -> DataFrame:
    """``MEASURED`` of every solved configuration on every group ``grp`` (``groups`` of them) of
    ``rows``.  Some configurations and one group go to a task, which holds the group's rows."""
    ids = np.array(sorted(solved), np.int32)
    weights = np.stack([solved[i][0] for i in ids], 1)
    intercepts = np.array([solved[i][1] for i in ids]) + gram.means @ weights
    d, mu = len(gram.cols), gram.means
    chunks = max(1, min(len(ids), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(1, groups))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ranks, grp = matrix(b.column("x"), d), b.column("true_rank").to_numpy(zero_copy_only=False).astype(np.int64), groups_of(b.column("grp"))
            for g in np.unique(grp):
                own = grp == g
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([x[own].tobytes()], pa.binary()), pa.array([ranks[own].tobytes()], pa.binary())],
                                                 ["grp", "x", "ranks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault((r["grp"], r["chunk"]), []).append((r["x"], r["ranks"]))
        while held:
            (grp, chunk), blocks = held.popitem()
            z = np.concatenate([np.frombuffer(x).reshape(-1, d) for x, _ in blocks]) - mu
            np.nan_to_num(z, copy=False)
            ranks = np.concatenate([np.frombuffer(r, np.int64) for _, r in blocks])
            del blocks
            own = np.arange(chunk, len(ids), chunks)
            step = max(1, (1 << 20) // len(z))
            made = []
            for at in range(0, len(own), step):
                some = own[at:at + step]
                made += [rank_measures(s, ranks) for s in np.ascontiguousarray((z @ weights[:, some] + intercepts[some]).T)]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([part] * n, pa.string()), pa.array([None if grp == NO_GROUP else grp] * n, pa.int32()),
                                              *[pa.array(v, pa.float64()) for v in zip(*made)], pa.nulls(n, pa.string())], [c.split()[0] for c in MEASURED.split(", ")])

    blocks = rows.select(vectors(gram.cols), "true_rank", "grp").mapInArrow(pack, "grp int, x binary, ranks binary")
    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.repartition(chunks * max(1, groups), "grp", "chunk").mapInArrow(run, MEASURED)
