"""Models fitted by gradients that Spark sums over all rows: multi-layer perceptrons and
epsilon-insensitive support vector regression (linear, or radial through random Fourier features).

The rows are staged once as blocks of scaled values, which Spark holds while the fit lasts.  One
evaluation is one pass: every task adds loss and gradient of its blocks, and a limited-memory quasi-Newton step on the driver moves the few thousand weights.  A perceptron
holds a tenth of the rows out and stops when their loss no longer falls.

:func:`fit_arrays` runs the same evaluations inside one task on a matrix of a checked size.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scaling
from ..session import materialize
from .gram import GATHER, matrix, matrix_sum, vectors

BLOCK_ROWS = 8192
HELD_OUT = 0.1
MEMORY, MAX_STEPS = 10, 1000
#: evaluations without a better held-out loss (or steps without a better loss) before the end
PATIENCE, IMPROVED = 10, 1e-4


@dataclass(frozen=True)
class Perceptron:
    """Hidden layers of rectified units; squared error and ``alpha`` |w|^2, halved."""

    hidden: tuple[int, ...]
    alpha: float = 1e-4
    seed: int = 42
    held_out: float = HELD_OUT

    def _layers(self, theta: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes, out, at = [d, *self.hidden, 1], [], 0
        for a, b in zip(sizes, sizes[1:]):
            out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def start(self, d: int) -> np.ndarray:
        rng, sizes, parts = np.random.default_rng(self.seed), [d, *self.hidden, 1], []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def outcome(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        layers = self._layers(theta, x.shape[1])
        for w, b in layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        return (x @ layers[-1][0] + layers[-1][1])[:, 0]

    def losses(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.outcome(theta, x) - y) ** 2 / 2

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the losses and its gradient."""
        layers, seen = self._layers(theta, x.shape[1]), [x]
        for w, b in layers[:-1]:
            seen.append(np.maximum(seen[-1] @ w + b, 0))
        off = seen[-1] @ layers[-1][0] + layers[-1][1] - y[:, None]
        parts, back = [], off
        for (w, _), a in zip(layers[::-1], seen[::-1]):
            parts = [(a.T @ back).ravel(), back.sum(axis=0), *parts]
            back = (back @ w.T) * (a > 0)
        return float((off ** 2).sum() / 2), np.concatenate(parts)

    def penalty(self, theta: np.ndarray, d: int) -> tuple[float, np.ndarray]:
        out, value, at = np.zeros_like(theta), 0.0, 0
        for w, b in self._layers(theta, d):
            out[at:at + w.size] = self.alpha * w.ravel()
            value += self.alpha * float((w ** 2).sum()) / 2
            at += w.size + b.size
        return value, out


@dataclass(frozen=True)
class SupportVectors:
    """|w|^2 / 2 + C sum max(0, |f - y| - epsilon), its corner rounded over ``round``.  A radial
    kernel exp(-gamma |x - z|^2) is approximated by ``features`` random cosines."""

    c: float
    kernel: str = "linear"
    gamma: float = 0.0
    epsilon: float = 0.1
    round: float = 0.005
    features: int = 512
    seed: int = 42
    held_out: float = 0.0

    def mapped(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return x
        rng = np.random.default_rng(self.seed)
        omega = rng.normal(size=(x.shape[1], self.features)) * np.sqrt(2 * self.gamma)
        return np.sqrt(2.0 / self.features) * np.cos(x @ omega + rng.uniform(0, 2 * np.pi, self.features))

    def start(self, d: int) -> np.ndarray:
        return np.zeros((d if self.kernel == "linear" else self.features) + 1)

    def outcome(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ theta[:-1] + theta[-1]

    def losses(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._cost(self.outcome(theta, x) - y)

    def _cost(self, off: np.ndarray) -> np.ndarray:
        over = np.abs(off) - self.epsilon
        return self.c * np.where(over <= 0, 0.0, np.where(over < self.round, over ** 2 / (2 * self.round), over - self.round / 2))

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        z = self.mapped(x)
        off = z @ theta[:-1] + theta[-1] - y
        slope = self.c * np.sign(off) * np.clip((np.abs(off) - self.epsilon) / self.round, 0, 1)
        return float(self._cost(off).sum()), np.append(z.T @ slope, slope.sum())

    def penalty(self, theta: np.ndarray, d: int) -> tuple[float, np.ndarray]:
        return float((theta[:-1] ** 2).sum() / 2), np.append(theta[:-1], 0.0)


def model_of(kind: str, params: dict, seed: int = 42) -> Perceptron | SupportVectors:
    if kind == "nn":
        return Perceptron(tuple(params["hidden_layer_sizes"]), float(params["alpha"]), seed)
    if kind == "svm":
        return SupportVectors(float(params["C"]), params["kernel"], seed=seed)
    raise ValueError(f"no gradient model {kind!r}")


# --- evaluations ----------------------------------------------------------------------------


def _parted(model, x: np.ndarray, y: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """The rows of a block that are fitted on, and those held out."""
    if not model.held_out:
        return x, y, x[:0], y[:0]
    out = np.random.default_rng([model.seed, 5, block]).random(len(y)) < model.held_out
    return x[~out], y[~out], x[out], y[out]


def _sums(model, theta: np.ndarray, x: np.ndarray, y: np.ndarray, x_out: np.ndarray, y_out: np.ndarray) -> np.ndarray:
    """[rows, loss, held-out rows, held-out loss, gradient...] of one block."""
    loss, gradient = model.loss(theta, x, y)
    held = model.losses(theta, x_out, y_out).sum() if len(y_out) else 0.0
    return np.concatenate([[len(y), loss, len(y_out), held], gradient])


def minimise(total: Callable[[np.ndarray], np.ndarray], model, d: int, until: float | None = None) -> np.ndarray:
    """Quasi-Newton steps with backtracking; ``total`` sums :func:`_sums` over all rows."""
    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, float]:
        if until is not None and time.monotonic() > until:
            raise TimeoutError("not fitted in time")
        s = total(theta)
        value, gradient = model.penalty(theta, d)
        n = max(s[0], 1.0)
        return (s[1] + value) / n, (s[4:] + gradient) / n, s[3] / s[2] if s[2] else np.nan

    theta = model.start(d)
    loss, gradient, held = evaluate(theta)
    best, best_theta, stale = (loss if np.isnan(held) else held), theta, 0
    history: deque = deque(maxlen=MEMORY)
    for _ in range(MAX_STEPS):
        step, alphas = gradient.copy(), []
        for s, g in reversed(history):
            alphas.append(s @ step / (s @ g))
            step -= alphas[-1] * g
        if history:
            s, g = history[-1]
            step *= (s @ g) / (g @ g)
        for (s, g), a in zip(history, reversed(alphas)):
            step += s * (a - g @ step / (s @ g))
        slope = float(gradient @ step)
        if slope <= 0 or not np.isfinite(slope):
            history.clear()
            step, slope = gradient, float(gradient @ gradient)
        size = 1.0 if history else min(1.0, 1.0 / max(np.abs(step).sum(), 1e-12))
        while size > 1e-10:
            new = theta - size * step
            new_loss, new_gradient, new_held = evaluate(new)
            if new_loss <= loss - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break                                   # no step goes down: rounding is all that is left
        moved, turned = new - theta, new_gradient - gradient
        if moved @ turned > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(turned):
            history.append((moved, turned))
        theta, loss, gradient, held = new, new_loss, new_gradient, new_held
        now = loss if np.isnan(held) else held
        stale = 0 if now < best * (1 - IMPROVED) else stale + 1
        if now < best:
            best, best_theta = now, theta
        if stale >= PATIENCE or not loss:
            break
    return best_theta


@dataclass
class Fitted:
    """A model with its preparation: means for missing values, then (x - centre) / scale."""

    model: Perceptron | SupportVectors
    theta: np.ndarray
    cols: list[str]
    means: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def outcome(self, x: np.ndarray) -> np.ndarray:
        return self.model.outcome(self.theta, (np.where(np.isnan(x), self.means, x) - self.centre) / self.scale)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        fitted = self

        @F.pandas_udf("double")
        def predict(rows: pd.Series) -> pd.Series:
            x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), len(fitted.cols))
            return pd.Series(fitted.outcome(x))

        return df.withColumn(out, predict(vectors(self.cols)))


def _with_gamma(model, mean: float, square: float, d: int):
    """The radial width that 1 / (columns x variance of the scaled values) sets."""
    if isinstance(model, SupportVectors) and model.kernel != "linear" and not model.gamma:
        spread = square - mean * mean
        return replace(model, gamma=1.0 / (d * spread) if spread > 0 else 1.0)
    return model


def fit_arrays(x: np.ndarray, y: np.ndarray, model, scaler: str = "standard", until: float | None = None, cols: list[str] | None = None) -> Fitted:
    means = np.array([c[~np.isnan(c)].mean() if (~np.isnan(c)).any() else 0.0 for c in x.T])
    z = np.where(np.isnan(x), means, x)
    low, high = (np.percentile(z, q, axis=0) for q in (25, 75))
    centre, scale = {"none": (0 * means, 0 * means + 1), "standard": (z.mean(axis=0), z.std(axis=0)), "minmax": (z.min(axis=0), np.ptp(z, axis=0)),
                     "robust": (np.median(z, axis=0), high - low)}[scaler]
    scale = np.where(scale > 0, scale, 1.0)
    z, d = (z - centre) / scale, x.shape[1]
    model = _with_gamma(model, float(z.mean()), float((z ** 2).mean()), d)
    within = model
    if isinstance(model, SupportVectors) and model.kernel != "linear":       # mapped once, then linear in the cosines
        z, d, within = model.mapped(z), model.features, replace(model, kernel="linear")
    parts = _parted(within, z, y, 0)
    theta = minimise(lambda t: _sums(within, t, *parts), within, d, until)
    d = x.shape[1]
    return Fitted(model, theta, cols or [str(i) for i in range(d)], means, centre, scale)


def fit_frame(train: DataFrame, cols: list[str], label: str, model, scaler: str = "standard") -> Fitted:
    """Fit on all rows of a staged frame that have a label."""
    cols, d = list(cols), len(cols)
    train = train.where(F.col(label).isNotNull())
    means = {c: 0.0 if m is None else float(m) for c, m in scaling.fit_means(train, cols).items()}
    params = scaling.fit_scaler(scaling.apply_fill(train, means), cols, scaler)
    mu = np.array([means[c] for c in cols])
    centre, scale = (np.array([float(params[c][i] or 0.0) for c in cols]) for i in (0, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                x = matrix(b.column("x"), d)
                z = (np.where(np.isnan(x), mu, x) - centre) / scale
                y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    blocks = materialize(train.select(vectors(cols), F.col(label).cast("double").alias("y")).mapInArrow(pack, "x binary, y binary")
                         .withColumn("block", F.monotonically_increasing_id()))

    def over(b: pa.RecordBatch, of: Callable) -> np.ndarray:
        return sum(of(np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["y"]), r["block"]) for r in b.to_pylist())

    moments = matrix_sum(blocks, (3,), lambda b: over(b, lambda x, y, _: np.array([x.size, x.sum(), (x ** 2).sum()])))
    if not moments[0]:
        raise ValueError("no rows to fit on")
    model = _with_gamma(model, moments[1] / moments[0], moments[2] / moments[0], d)
    width = len(model.start(d)) + 4

    held = blocks.rdd.map(lambda r: _parted(model, np.frombuffer(r.x).reshape(-1, d), np.frombuffer(r.y), r.block)).persist(StorageLevel.MEMORY_AND_DISK)

    def total(theta: np.ndarray) -> np.ndarray:
        def run(parts):
            yield sum((_sums(model, theta, *part) for part in parts), np.zeros(width))

        sums = held.mapPartitions(run)
        return np.sum(sums.collect(), axis=0) if held.getNumPartitions() <= GATHER else sums.treeReduce(lambda a, b: a + b)

    theta = minimise(total, model, d)
    held.unpersist()
    return Fitted(model, theta, cols, mu, centre, scale)
