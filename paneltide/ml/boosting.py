"""Second-order histogram boosting as Spark jobs.

A tree grows by passes over the rows.  One pass serves every open leaf of every tree that is
being grown (the K trees of a softmax round): each task routes its rows and adds gradient,
Hessian and row count per (tree, leaf, feature, bin).  Of two sister leaves only the smaller
is counted; the other is what is left of their parent.  The histograms of all tasks are added
(by Spark first where they are many), and the driver picks the leaf to split next: the one of
largest gain (``leaves``) or level by level (``depth`` alone).  What reaches the driver is as
large as the open leaves and the bins, however many rows there are.

Missing values have a bin of their own and go to the side that gains more.  Rows are staged
once as blocks of binned values and held by Spark with their running scores; the scores are
written back every ``STAGE_TREES`` trees, so a lost executor rereads files and evaluates a
bounded number of trees.

The same growth runs inside one task on a table of a checked size (:func:`fit_arrays`), which the
configuration search uses to fit one configuration per task.  The trees of a forest do not
depend on each other: passes split their nodes until a task can hold the rows of one, and tasks
grow the rest (:func:`fit_forest`).  Such trees may be as large as the table, so they stay where
they are, and rows meet them there.  Its bins, draws of rows and splits follow the same rules at any size.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_paths, materialize

#: trees after which running scores are written
STAGE_TREES = 96
#: rows of a block (one binary value of bins, one of labels, one of scores)
BLOCK_ROWS = 1 << 15
#: leaves whose histograms one pass makes
OPEN_LEAVES = 512
#: binned values (rows x columns) up to which one task fits boosted trees on all rows; beyond,
#: passes do, as they are faster from here on
TASK_CELLS = 8 << 20
#: binned values up to which one task grows a forest's tree, or the part of one below a node
FOREST_CELLS = 32 << 20
#: bytes of bins and scores that one task of a pass holds
TASK_BYTES = 64 << 20
#: bytes of partial histograms that the driver adds itself; more are added by tasks first
GATHER_BYTES = 32 << 20
#: cells of a code that stands for the bins of several columns
CODE_CELLS = 4096
#: leaves whose splits are sought together
LEAVES_AT_ONCE = 16
#: nodes of a tree up to which rows are split node by node
FEW_NODES = 128
#: rows a leaf has on average from which on its histogram is an array over all bins
DENSE_ROWS = 64
#: trees of a forest that share a stream of random numbers
FOREST_BATCH = 16
MISSING = 255
MIN_HESSIAN_SOFTMAX = 1e-16


@dataclass(frozen=True)
class Params:
    """``leaves`` = 0 grows level by level to ``depth``; ``depth`` = 0 has no limit."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 0
    leaves: int = 0
    lam: float = 0.0
    min_rows: int = 1
    min_hessian: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 254
    objective: str = "squared"          # squared | logistic | softmax | forest
    classes: int = 1
    seed: int = 42

    @property
    def trees_a_round(self) -> int:
        return self.classes if self.objective == "softmax" else 1


# --- growing one generation of trees ------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made; ``left`` = -1 marks a leaf.  A row goes left if its
    bin is at most ``cut``; the missing bin goes left if ``missing_left``."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, s: Split) -> tuple[int, int]:
        made = (len(self.left), len(self.left) + 1)
        self.feature[node], self.cut[node], self.missing_left[node] = s.feature, s.cut, s.missing_left
        self.left[node], self.right[node] = made
        for _ in made:
            self.feature.append(0), self.cut.append(0), self.missing_left.append(False), self.left.append(-1)
            self.right.append(-1), self.value.append(0.0), self.depth.append(self.depth[node] + 1)
        return made

    def route(self, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row of a (rows, features) matrix of bins; ``at`` are nodes that the
        rows have reached already, and is moved on."""
        if at is None and len(self.left) <= FEW_NODES:
            at = np.zeros(len(bins), np.int64)
            for leaf, r in self.rows(bins).items():
                at[r] = leaf
            return at
        at = np.zeros(len(bins), np.int64) if at is None else at
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        right, missing_left = np.array(self.right), np.array(self.missing_left)
        r = np.flatnonzero(left[at] >= 0)
        while len(r):
            node = at[r]
            b = bins[r, feature[node]]
            goes = np.where(b == MISSING, missing_left[node], b <= cut[node])
            node = np.where(goes, left[node], right[node])
            at[r] = node
            r = r[left[node] >= 0]
        return at

    def rows(self, bins: np.ndarray, leaves: set[int] | None = None, some: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """The rows (of all, or of ``some``) in each leaf, or in each of ``leaves``."""
        up = {child: node for node in range(len(self.left)) if self.left[node] >= 0 for child in (self.left[node], self.right[node])}
        seek = set(range(len(self.left)))
        if leaves is not None:                                  # other sides are not followed
            seek = set(leaves)
            for node in leaves:
                while node in up and (node := up[node]) not in seek:
                    seek.add(node)
        out, stack = {}, [(0, some)] if 0 in seek else []
        while stack:
            node, r = stack.pop()
            if self.left[node] < 0 or (leaves is not None and node in leaves):
                out[node] = np.arange(len(bins)) if r is None else r
                continue
            column = bins[:, self.feature[node]]
            b = column if r is None else column.take(r)
            goes = b <= self.cut[node]
            if self.missing_left[node]:
                goes |= b == MISSING
            for child, side in ((self.left[node], goes), (self.right[node], ~goes)):
                if child in seek:
                    stack.append((child, np.flatnonzero(side) if r is None else r[side]))
        return out


@dataclass(frozen=True)
class Split:
    """The best split of a leaf, and the sums of gradient, Hessian and rows on both sides."""

    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]


def score_of(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    h = h + lam if lam else h
    return np.divide(g * g, h, out=np.zeros(h.shape), where=h > 0)


def best_splits(sums: np.ndarray, p: Params) -> list[Split | None]:
    """The best split of every leaf of a histogram: sums of gradient, Hessian and rows of each
    (leaf, feature, bin), the missing bin last."""
    out: list[Split | None] = []
    for at in range(0, sums.shape[1], LEAVES_AT_ONCE):
        out += _best_splits(sums[:, at:at + LEAVES_AT_ONCE], p)
    return out


def _best_splits(sums: np.ndarray, p: Params) -> list[Split | None]:
    n, cols = sums.shape[1:3]
    same = np.array_equal(sums[1], sums[2])                  # squared error: the Hessian is the row count
    lost = sums[..., MISSING]
    run = [np.cumsum(v, axis=-1) for v in (sums[:2] if same else sums)]
    run = run + run[1:] if same else run
    whole = [r[..., -1:] for r in run]
    run = [r[..., :MISSING] for r in run]                    # rows up to this bin, missing ones right
    full = sums[2, ..., :MISSING] != 0
    parent = score_of(whole[0], whole[1], p.lam)
    best, chosen, other = np.full((n, cols), -np.inf), np.zeros((n, cols), np.int64), np.zeros((n, cols), bool)
    for to_left in (False, True):
        if to_left and not (lost[2] > 0).any():
            break
        a = [r + m[..., None] for r, m in zip(run, lost)] if to_left else run
        b = [t - v for t, v in zip(whole, a)]
        gain = np.round(score_of(a[0], a[1], p.lam) + score_of(b[0], b[1], p.lam) - parent, 9)      # equal gains tie however the sums were added
        ok = full & (a[2] >= p.min_rows - 1e-9) & (b[2] >= p.min_rows - 1e-9)
        if p.min_hessian:
            ok &= (a[1] >= p.min_hessian) & (b[1] >= p.min_hessian)
        if to_left:
            ok &= lost[2][..., None] > 0
        gain[~ok] = -np.inf
        at = gain.argmax(axis=-1)
        top = np.take_along_axis(gain, at[..., None], -1)[..., 0]
        better = top > best
        best[better], chosen[better], other[better] = top[better], at[better], to_left
    best[best <= 1e-12 * np.maximum(1.0, np.abs(parent[..., 0]))] = -np.inf
    out: list[Split | None] = []
    for i, f in enumerate(best.argmax(axis=1)):              # ties: the first feature
        if best[i, f] == -np.inf:
            out.append(None)
            continue
        left = [float(r[i, f, chosen[i, f]] + (lost[j, i, f] if other[i, f] else 0.0)) for j, r in enumerate(run)]
        right = [float(t[i, f, 0] - v) for t, v in zip(whole, left)]
        out.append(Split(float(best[i, f]), int(f), int(chosen[i, f]), bool(other[i, f]), tuple(left), tuple(right)))
    return out


#: finds the best split of the wanted (tree, node) leaves: one pass over the rows
Finder = Callable[[list[Tree], list[tuple[int, int]]], dict[tuple[int, int], Split]]


def grow(n_trees: int, totals: list[tuple[float, float, float]], find: Finder, p: Params, scale: float, rest: int = 0) -> list[Tree]:
    """``n_trees`` trees from their root sums.  All open leaves of all trees share a pass.  Leaves
    of at most ``rest`` rows are left as they are."""
    trees = [Tree() for _ in range(n_trees)]
    sums = [[tuple(t)] for t in totals]
    known: list[dict[int, Split | None]] = [{} for _ in trees]
    while True:
        wanted = []
        for k, tree in enumerate(trees):
            for node in _chosen(tree, known[k], p)[1]:
                if sums[k][node][2] < 2 * p.min_rows - 1e-9 or sums[k][node][2] <= rest:
                    known[k][node] = None
                else:
                    wanted.append((k, node))
        if not wanted:
            break
        wanted = wanted[:OPEN_LEAVES]
        found = find(trees, wanted)
        for k, node in wanted:
            s = found.get((k, node))
            known[k][node] = s
            if s is not None:                       # explored; whether it is kept is settled at the end
                trees[k].split(node, s)
                sums[k] += [s.left, s.right]
    return [_kept(tree, known[k], sums[k], p, scale) for k, tree in enumerate(trees)]


def _chosen(tree: Tree, known: dict[int, Split | None], p: Params) -> tuple[set[int], list[int]]:
    """(nodes that are split, leaves whose best split is not known yet) by largest gain first."""
    may = lambda n: not p.depth or tree.depth[n] < p.depth
    split, unknown, heap = set(), [], []

    def look(n: int) -> None:
        if not may(n):
            return
        if n not in known:
            unknown.append(n)
        elif known[n] is not None:
            heapq.heappush(heap, (-known[n].gain, n))

    look(0)
    while heap and (not p.leaves or len(split) + 1 < p.leaves):
        _, n = heapq.heappop(heap)
        split.add(n)
        look(tree.left[n])
        look(tree.right[n])
    return split, unknown


def _kept(tree: Tree, known: dict[int, Split | None], sums: list[tuple], p: Params, scale: float) -> Tree:
    """The tree without splits that were looked at but lost to larger ones, with leaf values."""
    split, _ = _chosen(tree, known, p)
    out = Tree()

    def value(node: int) -> float:
        g, h, _ = sums[node]
        return -scale * g / (h + p.lam) if h + p.lam > 0 else 0.0

    stack = [(0, 0)]
    while stack:
        old, new = stack.pop()
        if old in split:
            a, b = out.split(new, known[old])
            stack += [(tree.left[old], a), (tree.right[old], b)]
        else:
            out.value[new] = value(old)
    return out


# --- objectives ----------------------------------------------------------------------------


def base_scores(p: Params, y_sum: np.ndarray, w_sum: float) -> np.ndarray:
    """Start scores: the mean, its log-odds, or zero for each class."""
    if p.objective == "softmax":
        return np.zeros(p.classes)
    mean = float(y_sum[0] / w_sum) if w_sum else 0.0
    if p.objective == "logistic":
        mean = min(max(mean, 1e-12), 1 - 1e-12)
        return np.array([math.log(mean / (1 - mean))])
    return np.array([0.0 if p.objective == "forest" else mean])


def gradients(p: Params, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of shape (rows, trees a round)."""
    if p.objective == "softmax":
        prob = softmax(score)
        hit = y[:, None] == np.arange(p.classes)
        return (prob - hit) * w[:, None], np.maximum(2 * prob * (1 - prob), MIN_HESSIAN_SOFTMAX) * w[:, None]
    if p.objective == "logistic":
        prob = 1 / (1 + np.exp(-score))
        return (prob - y[:, None]) * w[:, None], np.maximum(prob * (1 - prob), 1e-16) * w[:, None]
    return (score - y[:, None]) * w[:, None], np.repeat(w[:, None], score.shape[1], axis=1)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- bins ----------------------------------------------------------------------------------


def edges_of(df: DataFrame, cols: list[str], bins: int) -> list[np.ndarray]:
    """Upper bin edges of each column: quantiles within 1/(4 bins), every value if few.  Tasks
    sum their rows up as weighted values, and a task per column joins those."""
    cols, points = list(cols), 16 * (bins + 2)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n = [[] for _ in cols], [], 0

        def close() -> None:
            x = np.concatenate(held)
            for part, column in zip(parts, x.T):
                part.append(_thinned(*np.unique(column[~np.isnan(column)], return_counts=True), 2 * points))
                if len(part) > 64:
                    part[:] = [_thinned(*_joined(part), 64 * points)]

        for b in batches:
            held.append(b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(cols)))
            n += b.num_rows
            if n >= 1 << 18:
                close()
                held, n = [], 0
        if n:
            close()
        made = [_thinned(*_joined(part), points) for part in parts if part]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([v.tobytes() for v, _ in made], pa.binary()),
                                          pa.array([c.astype(np.int64).tobytes() for _, c in made], pa.binary())], ["col", "v", "c"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        v, c = _joined([(np.frombuffer(v), np.frombuffer(c, np.int64)) for v, c in zip(pdf["v"], pdf["c"])])
        run = np.cumsum(c)
        places = np.searchsorted(run, np.ceil(np.arange(1, bins + 1) * (run[-1] if len(run) else 0) / bins)) if len(v) > bins else np.arange(len(v))
        return pd.DataFrame({"col": [pdf["col"].iloc[0]], "edges": [np.unique(v[places])[:-1].tobytes()]})

    if not cols:
        return []
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    found = {r.col: np.frombuffer(r.edges) for r in rows.mapInArrow(summed, "col int, v binary, c binary").groupBy("col")
             .applyInPandas(cut, "col int, edges binary").collect()}
    return [found.get(i, np.zeros(0)) for i in range(len(cols))]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts of several such pairs."""
    v, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return v, np.bincount(at, np.concatenate([c for _, c in parts]), len(v)).astype(np.int64)


def _thinned(v: np.ndarray, c: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` values, each with the rows above the one before it: places move by at
    most one part in ``points``."""
    if len(v) <= points:
        return v, c
    run = np.cumsum(c)
    keep = np.unique(np.searchsorted(run, np.ceil(np.arange(1, points + 1) * run[-1] / points)))
    return v[keep], np.diff(run[keep], prepend=0)


def edges_of_matrix(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for column in x.T:
        v = np.sort(column[~np.isnan(column)])
        if len(v) > bins:
            v = v[np.minimum(np.ceil(np.arange(1, bins + 1) * len(v) / bins).astype(np.int64) - 1, len(v) - 1)]
        out.append(np.unique(v)[:-1])
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin i holds values above edge i-1 up to edge i; NaN is the missing bin."""
    out = np.empty(x.shape, np.uint8, order="F")
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], "left")
    out[np.isnan(x)] = MISSING
    return out


# --- the model -----------------------------------------------------------------------------


@dataclass
class Booster:
    """Trees by generation, over raw values: ``cut`` indexes ``edges`` of the feature."""

    params: Params
    cols: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    generations: list[list[Tree]]
    fill: np.ndarray | None = None          # what missing values are replaced by before anything else

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, trees a round) of a float matrix with NaN for missing values."""
        x = x if self.fill is None else np.where(np.isnan(x), self.fill, x)
        return self.raw_bins(to_bins(x, self.edges), 0, self.base)

    def raw_bins(self, bins: np.ndarray, start: int, score: np.ndarray) -> np.ndarray:
        width = self.params.trees_a_round
        score = np.broadcast_to(score, (len(bins), width)).copy()
        for trees in self.generations[start:]:
            for k, tree in enumerate(trees):
                score[:, k % width] += np.array(tree.value)[tree.route(bins)]
        return score

    def outcome(self, x: np.ndarray) -> np.ndarray:
        """Predictions, positive probabilities, or class probabilities."""
        score = self.raw(x)
        p = self.params
        if p.objective == "softmax":
            return softmax(score)
        if p.objective == "logistic":
            return 1 / (1 + np.exp(-score[:, 0]))
        if p.objective == "forest":
            return score[:, 0] / max(1, sum(map(len, self.generations)))
        return score[:, 0]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the predictions: a double, or an array of class probabilities."""
        model, kind = self, "array<double>" if self.params.objective == "softmax" else "double"

        @F.pandas_udf(kind)
        def predict(rows: pd.Series) -> pd.Series:
            x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), len(model.cols))
            made = model.outcome(x)
            return pd.Series(list(made) if made.ndim == 2 else made)

        return df.withColumn(out, predict(F.array(*[F.col(c).cast("double") for c in self.cols])))


def _generation_params(p: Params, number: int, cols: int, trees: int) -> np.ndarray:
    """Columns that each tree of a generation may use."""
    allowed = np.ones((trees, cols), bool)
    if p.column_share < 1:
        n = max(1, round(p.column_share * cols))
        for k in range(trees):
            keep = np.random.default_rng([p.seed, 7, number, k]).choice(cols, n, replace=False)
            allowed[k] = np.isin(np.arange(cols), keep)
    return allowed


def _row_weights(p: Params, number: int, trees: int, place: tuple[int, int], n: int) -> np.ndarray:
    """How often each row counts in each tree of a generation: all once, a share, or a
    bootstrap (Poisson, as other rows are not known).  ``place``: the rows' block, and the number of its
    first row among all rows.  For a forest each ``BLOCK_ROWS`` of all rows have a stream of
    their own, so its draws do not depend on how rows are dealt over tasks."""
    block, start = place
    if p.objective != "forest":
        if p.row_share >= 1:
            return np.ones((n, trees))
        rng = np.random.default_rng([p.seed, 11, number, block])
        return np.repeat((rng.random(n) < p.row_share).astype(float)[:, None], trees, axis=1)
    drawn = np.empty((n, trees))
    at = 0
    while at < n:
        stream, before = divmod(start + at, BLOCK_ROWS)
        some = min(BLOCK_ROWS - before, n - at)
        drawn[at:at + some] = np.random.default_rng([p.seed, 11, number, stream]).poisson(1.0, (before + some, trees))[before:]
        at += some
    return drawn


def _weighted(p: Params, number: int, trees: int, place: tuple[int, int], score, y, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, h = gradients(p, score, y, w)
    if g.shape[1] != trees:                       # a batch of forest trees shares one gradient
        g, h = np.repeat(g, trees, axis=1), np.repeat(h, trees, axis=1)
    counts = _row_weights(p, number, trees, place, len(y))
    return g * counts, h * counts, counts


class Codes:
    """The columns of a matrix of bins, those with few bins several to a code, so that one count
    serves them all."""

    def __init__(self, bins: np.ndarray, widths: list[int]):
        self.groups, sizes = [], []
        for f in sorted(range(bins.shape[1]), key=lambda f: -widths[f]):
            i = next((i for i, size in enumerate(sizes) if size * widths[f] <= CODE_CELLS), None)
            if i is None:
                self.groups.append([])
                sizes.append(1)
                i = len(sizes) - 1
            self.groups[i].append(f)
            sizes[i] *= widths[f]
        self.shapes = [tuple(widths[f] for f in g) for g in self.groups]
        self.columns = [self._code(bins, g, widths) for g in self.groups]

    @staticmethod
    def _code(bins: np.ndarray, group: list[int], widths: list[int]) -> np.ndarray:
        if len(group) == 1 and widths[group[0]] > MISSING:
            return np.ascontiguousarray(bins[:, group[0]])
        code = np.zeros(len(bins), np.uint16)
        for f in group:                                         # the last place of a column is the missing bin
            code = code * np.uint16(widths[f]) + np.minimum(bins[:, f], widths[f] - 1)
        return code

    def add_to(self, sums: np.ndarray, leaves: list[tuple[int, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]], use: np.ndarray) -> None:
        """Add gradient, Hessian and count of the rows of some (leaf, rows, g, h, c) to the histogram."""
        for group, shape, column in zip(self.groups, self.shapes, self.columns):
            if not use[group].any():
                continue
            size = int(np.prod(shape))
            for leaf, r, g, h, c in leaves:
                code = (column if r is None else column.take(r)).astype(np.intp)
                for planes, weight in ((slice(0, 1), g), *([(slice(1, 3), c)] if h is c else [(slice(1, 2), h), (slice(2, 3), c)])):
                    made = np.bincount(code, weight, size).reshape(shape)
                    for k, f in enumerate(group):
                        if use[f]:
                            part = made.sum(axis=tuple(i for i in range(len(shape)) if i != k)) if len(group) > 1 else made
                            sums[planes, leaf, f, :len(part) - 1] += part[:-1]
                            sums[planes, leaf, f, MISSING] += part[-1]


def _widths(edges: list[np.ndarray]) -> list[int]:
    """Bins of each column, with the missing one."""
    return [len(e) + 2 for e in edges]


def _add_histogram(sums: np.ndarray, codes: Codes, bins: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, grown: list[Tree],
                   numbers: list[tuple[int, np.ndarray]], allowed: np.ndarray) -> None:
    """Add gradient, Hessian and row count of every (leaf, feature, bin) to ``sums``; ``numbers``: tree
    and, of each of its nodes, the number of the wanted leaf (-1: none)."""
    for k, place in numbers:
        drawn = c[:, k] > 0
        some = None if drawn.all() else np.flatnonzero(drawn)
        leaves = []
        for node, r in grown[k].rows(bins, set(np.flatnonzero(place >= 0).tolist()), some).items():
            r = None if len(r) == len(bins) else r
            a, b, n = ((v[:, k] if r is None else v[:, k].take(r)) for v in (g, h, c))
            n = None if (n == 1).all() else n
            alike = (b == 1).all() if n is None else np.array_equal(b, n)               # squared error
            leaves.append((int(place[node]), r, a, n if alike else b, n))
        codes.add_to(sums, leaves, allowed[k])


def _numbers(trees: list[Tree], wanted: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """(tree, place of each of its nodes among the wanted ones or -1) of the trees with any."""
    out: dict[int, np.ndarray] = {}
    for i, (k, node) in enumerate(wanted):
        out.setdefault(k, np.full(len(trees[k].left), -1, np.int64))[node] = i
    return sorted(out.items())


class _Sisters:
    """A finder that has histograms measured only where they do not follow from others: of two
    leaves with a known parent, for the one with fewer rows."""

    def __init__(self, measure: Callable[[list[Tree], list[tuple[int, int]]], np.ndarray], n_cols: int, p: Params):
        self.measure, self.n_cols, self.p = measure, n_cols, p
        self.known: dict[tuple[int, int], np.ndarray] = {}
        self.found: dict[tuple[int, int], Split] = {}

    def __call__(self, trees: list[Tree], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], Split]:
        asked, follows = [], []
        here = set(wanted)
        for k, node in self.known:
            pair = [(k, trees[k].left[node]), (k, trees[k].right[node])]
            if trees[k].left[node] >= 0 and here.issuperset(pair):
                s = self.found[k, node]
                less, more = pair if s.left[2] <= s.right[2] else pair[::-1]
                follows.append((more, less, (k, node)))
        derived = {more for more, _, _ in follows}
        asked = [w for w in wanted if w not in derived]
        sums = self.measure(trees, asked)
        at = {w: i for i, w in enumerate(asked)}
        made = np.empty((3, len(wanted), self.n_cols, 256))
        place = {w: i for i, w in enumerate(wanted)}
        for w, i in at.items():
            made[:, place[w]] = sums[:, i]
        for more, less, parent in follows:
            rest = self.known.pop(parent) - sums[:, at[less]]
            made[:, place[more]] = np.where(rest[2] > 0, rest, 0.0)
        splits = {w: s for w, s in zip(wanted, best_splits(made, self.p)) if s is not None}
        for w, s in splits.items():
            if len(self.known) < OPEN_LEAVES:
                self.known[w], self.found[w] = made[:, place[w]], s
        return splits


def _generations(p: Params) -> Iterator[tuple[int, int]]:
    """(number, trees) of every generation: a round of boosting or a batch of forest trees."""
    if p.objective == "forest":
        for at in range(0, p.rounds, FOREST_BATCH):
            yield at // FOREST_BATCH, min(FOREST_BATCH, p.rounds - at)
    else:
        for r in range(p.rounds):
            yield r, p.trees_a_round


# --- inside one task -----------------------------------------------------------------------


def fit_arrays(x: np.ndarray, y: np.ndarray, p: Params, cols: list[str] | None = None, w: np.ndarray | None = None,
               edges: list[np.ndarray] | None = None, until: float | None = None) -> Booster:
    """Fit on a matrix of a size the caller has checked.  ``until`` is a deadline
    (``time.monotonic``); a fit that passes it raises ``TimeoutError``."""
    w = np.ones(len(y)) if w is None else w
    edges = edges_of_matrix(x, p.bins) if edges is None else edges
    bins, n_cols = np.asfortranarray(to_bins(x, edges)), x.shape[1]
    model = Booster(p, cols or [str(i) for i in range(n_cols)], edges, base_scores(p, np.array([(y * w).sum()]), float(w.sum())), [])
    score, codes = np.broadcast_to(model.base, (len(y), p.trees_a_round)).copy(), None if p.objective == "forest" else Codes(bins, _widths(edges))
    for number, trees in _generations(p):
        if p.objective == "forest":
            counts, allowed = _row_weights(p, number, trees, (0, 0), len(y)), _generation_params(p, number, n_cols, trees)
            model.generations.append([_forest_tree(bins, y, w, counts[:, k], allowed[k], p, p.depth or None, until) for k in range(trees)])
            continue
        _in_time(until, number, p)
        g, h, c = _weighted(p, number, trees, (0, 0), score, y, w)
        allowed = _generation_params(p, number, n_cols, trees)

        def measure(grown: list[Tree], wanted: list[tuple[int, int]]) -> np.ndarray:
            sums = np.zeros((3, len(wanted), n_cols, 256))
            _add_histogram(sums, codes, bins, g, h, c, grown, _numbers(grown, wanted), allowed)
            return sums

        totals = list(zip(g.sum(axis=0), h.sum(axis=0), c.sum(axis=0)))
        made = grow(trees, totals, _Sisters(measure, n_cols, p), p, p.rate)
        model.generations.append(made)
        for k, tree in enumerate(made):
            score[:, k] += np.array(tree.value)[tree.route(bins)]
    return model


def _in_time(until: float | None, number: int, p: Params) -> None:
    if until is not None and time.monotonic() > until:
        raise TimeoutError(f"not fitted in time: {p.rounds} rounds, stopped at {number}")


def _forest_tree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray, allowed: np.ndarray, p: Params, limit: int | None,
                 until: float | None = None) -> Tree:
    """One tree of a forest, level by level to ``limit``, on the rows its bootstrap draws."""
    use = np.flatnonzero(allowed)
    rows = np.flatnonzero(counts > 0)
    sums = [v[rows] for v in ((-y * w * counts, counts) if (w == 1).all() else (-y * w * counts, w * counts, counts))]
    at = np.zeros(len(rows), np.int64)                         # the open node of each row
    nodes = np.zeros(1, np.int64)                              # the open nodes
    whole = np.array([[v.sum() for v in (sums[0], sums[1], sums[-1])]])
    made = _Grown()
    made.add(whole, 0)
    depth = 0
    while len(nodes) and (limit is None or depth < limit):
        _in_time(until, depth, p)
        gain, feature, cut, missing_left, left, right = _level(bins, rows, at, sums, whole, use, p)
        split = np.flatnonzero(gain > -np.inf)
        if not len(split):
            break
        depth += 1
        below = np.stack([left[split], right[split]], 1).reshape(-1, 3)
        first = made.add(below, depth)
        made.split(nodes[split], feature[split], cut[split], missing_left[split], first + 2 * np.arange(len(split)))
        number_of = np.full(len(nodes), -1, np.int64)
        number_of[split] = np.arange(len(split))
        open_ = below[:, 2] >= 2 * p.min_rows - 1e-9
        again = np.cumsum(open_) - 1
        keep = number_of[at] >= 0
        rows, at = rows[keep], at[keep]
        b = bins[rows, feature[at]]
        child = 2 * number_of[at] + np.where(b == MISSING, ~missing_left[at], b > cut[at])
        stay = open_[child]
        rows, at, sums = rows[stay], again[child[stay]], [v[keep][stay] for v in sums]
        nodes, whole = first + np.flatnonzero(open_), below[open_]
    return made.tree(p)


class _Grown:
    """The nodes of a tree, a level at a time."""

    def __init__(self) -> None:
        self.n, self.sums, self.depth, self.splits = 0, [], [], []

    def add(self, sums: np.ndarray, depth: int) -> int:
        self.sums.append(sums)
        self.depth.append(np.full(len(sums), depth, np.int16))
        self.n += len(sums)
        return self.n - len(sums)

    def split(self, *columns: np.ndarray) -> None:
        self.splits.append(columns)

    def tree(self, p: Params) -> Tree:
        sums = np.concatenate(self.sums)
        h = sums[:, 1] + p.lam
        out = Tree(np.zeros(self.n, np.int16), np.zeros(self.n, np.uint8), np.zeros(self.n, bool), np.full(self.n, -1, np.int32),
                   np.full(self.n, -1, np.int32), np.divide(-sums[:, 0], h, out=np.zeros(self.n), where=h > 0), np.concatenate(self.depth))
        for node, feature, cut, missing_left, left in self.splits:
            out.feature[node], out.cut[node], out.missing_left[node], out.left[node], out.right[node] = feature, cut, missing_left, left, left + 1
        out.value[out.left >= 0] = 0.0
        return out


def _level(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, sums: list[np.ndarray], whole: np.ndarray, use: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """The best split of each open node (gain -inf: none), a feature at a time; ``whole`` are
    the sums of the nodes."""
    n = len(whole)
    gain, feature, cut = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    missing_left, left = np.zeros(n, bool), np.zeros((n, 3))
    if len(rows) * len(use) <= 1 << 16:                        # all features in one go
        cell = (((at * len(use))[:, None] + np.arange(len(use))) << 8) + bins[np.ix_(rows, use)]
        order = np.sort(((cell << 24) | np.arange(len(rows))[:, None]).ravel())
        of, gain_, cut_, missing_, left_ = _best_cells(*_sorted_cells(order >> 24, order & 0xFFFFFF, sums), np.repeat(whole, len(use), axis=0), p)
        if len(of):
            node = of // len(use)
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            first = np.flatnonzero(gain_ == np.repeat(np.maximum.reduceat(gain_, begin), np.diff(np.r_[begin, len(node)])))
            to, i = np.unique(node[first], return_index=True)
            i = first[i]
            gain[to], feature[to], cut[to], missing_left[to], left[to] = gain_[i], use[of[i] % len(use)], cut_[i], missing_[i], left_[i]
        return gain, feature, cut, missing_left, left, whole - left
    place = np.arange(len(rows))
    for f in use:
        cell = (at << 8) + bins[:, f].take(rows)
        if len(rows) >= n * DENSE_ROWS:
            all_ = [np.bincount(cell, v, n << 8) for v in sums]
            key = np.flatnonzero(all_[-1])
            cells = key, [np.cumsum(v[key]) for v in all_]
        else:
            order = np.sort((cell << 32) | place)
            cells = _sorted_cells(order >> 32, order & 0xFFFFFFFF, sums)
        node, gain_, cut_, missing_, left_ = _best_cells(*cells, whole, p)
        better = gain_ > gain[node]
        to = node[better]
        gain[to], feature[to], cut[to], missing_left[to], left[to] = gain_[better], f, cut_[better], missing_[better], left_[better]
    return gain, feature, cut, missing_left, left, whole - left


def _sorted_cells(cell: np.ndarray, rows: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells of rows sorted by cell, and the sums up to each cell's end."""
    end = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    return cell[end], [np.cumsum(v[rows])[end] for v in sums]


def _best_cells(cell: np.ndarray, run: list[np.ndarray], whole: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """The best split of each group of cells (group << 8 | bin, sorted): group, gain, cut, missing rows
    to the left, sums of the left side.  ``run``: sums up to each cell; ``whole``: of each group."""
    of, bins = cell >> 8, cell & 255
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    group, size = of[begin], np.diff(np.r_[begin, len(of)])
    left = [r - np.repeat(np.r_[0.0, r][begin], size) for r in run]
    if len(left) == 2:                                         # rows of weight 1: the Hessian is the row count
        left.append(left[1])
    total = [whole[:, j][of] for j in range(3)]
    lost = bins == MISSING
    parent = score_of(whole[group, 0], whole[group, 1], p.lam)
    best, chosen, other = np.full(len(group), -np.inf), np.zeros(len(group), np.int64), np.zeros(len(group), bool)
    some, missing = lost.any(), None
    if some:
        last = begin + size - 1                                # the missing bin is the last
        has = lost[last]
        missing = [np.where(has, v[last] - np.where(size > 1, v[np.maximum(last - 1, 0)], 0.0), 0.0) for v in left]
    for to_left in (False, True)[:1 + some]:
        a = [v + np.repeat(m, size) for v, m in zip(left, missing)] if to_left else left
        b = [t - v for t, v in zip(total, a)]
        gain = np.round(score_of(a[0], a[1], p.lam) + score_of(b[0], b[1], p.lam) - np.repeat(parent, size), 9)
        ok = (a[2] >= p.min_rows - 1e-9) & (b[2] >= p.min_rows - 1e-9) & ~lost
        if p.min_hessian:
            ok &= (a[1] >= p.min_hessian) & (b[1] >= p.min_hessian)
        if to_left:
            ok &= np.repeat(missing[2] > 0, size)
        gain[~ok] = -np.inf
        top = np.maximum.reduceat(gain, begin)
        first = np.flatnonzero(gain == np.repeat(top, size))
        at = first[np.flatnonzero(np.r_[True, of[first][1:] != of[first][:-1]])]
        better = top > best
        best[better], chosen[better], other[better] = top[better], at[better], to_left
    has = np.flatnonzero(best > 1e-12 * np.maximum(1.0, np.abs(parent)))
    at = chosen[has]
    left = np.stack([v[at] + (np.where(other[has], m[has], 0.0) if some else 0.0) for v, m in zip(left, missing or left)], 1)
    return group[has], best[has], bins[at], other[has], left


def fit_frame(df: DataFrame, cols: list[str], label: str, p: Params, weight: str | None = None,
              fill: dict[str, float] | None = None) -> Booster | Forest:
    """Fit on a staged frame: a forest by :func:`fit_forest`; boosted trees in one task while rows x
    columns stay within ``TASK_CELLS`` (counted), with passes over all tasks beyond.  ``fill``
    replaces missing values."""
    cols = list(cols)
    df = df.where(F.col(label).isNotNull())
    if fill:
        df = df.fillna({c: fill[c] for c in cols if fill.get(c) is not None})
    if p.objective == "forest":
        model = fit_forest(df, cols, label, p, weight)
    elif df.count() * max(1, len(cols)) <= TASK_CELLS:
        model = _fit_in_one_task(df, cols, label, p, weight)
    else:
        model = fit(df, cols, label, p, weight)
    if fill:
        model.fill = np.array([np.nan if fill.get(c) is None else fill[c] for c in cols], float)
    return model


def _fit_in_one_task(df: DataFrame, cols: list[str], label: str, p: Params, weight: str | None) -> Booster:
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.col(label).cast("double").alias("y"),
                     (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            x = whole.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(whole.num_rows, len(cols))
            model = fit_arrays(x, whole.column("y").to_numpy().astype(float), p, cols, whole.column("w").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.coalesce(1).mapInArrow(train, "model binary").collect()
    if not made:
        raise ValueError("no rows to fit on")
    return pickle.loads(made[0].model)


# --- over a DataFrame ----------------------------------------------------------------------

BLOCKS = "block long, n int, bins binary, y binary, w binary, score binary"


def _staged(df: DataFrame, cols: list[str], label: str, weight: str | None, edges: list[np.ndarray], base: np.ndarray, width: int) -> DataFrame:
    """The binned rows as blocks, in an order that is written down once."""
    numbers = [F.col(c).cast("double") for c in cols]
    rows = df.select(F.array(*numbers).alias("x"), F.col(label).cast("double").alias("y"),
                     (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                held.append(whole.slice(at, BLOCK_ROWS - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held)
        x = b.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(cols))
        y, w = (b.column(c).to_numpy().astype(float) for c in ("y", "w"))
        return _block([0], [b.num_rows], [to_bins(x, edges).T.tobytes()], [y.tobytes()], [w.tobytes()],
                      [np.broadcast_to(base, (b.num_rows, width)).tobytes()])

    return materialize(rows.mapInArrow(pack, BLOCKS).withColumn("block", F.monotonically_increasing_id()))


def _block(*cols: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _held(blocks: DataFrame, starts: dict[int, int], n_cols: int, width: int):
    """The staged blocks spread evenly over tasks, as tuples that stay in Spark's storage: the block
    and the number of its first row, bins, labels, weights, scores."""
    from pyspark import StorageLevel
    sc = blocks.sparkSession.sparkContext
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("bins") + F.length("score")).alias("bytes")).first()
    tasks = max(1, min(size.blocks, max(sc.defaultParallelism, -(-(size.bytes or 0) // TASK_BYTES))))
    return blocks.repartition(tasks).rdd.map(
        lambda r: ((r.block, starts[r.block]), np.frombuffer(r.bins, np.uint8).reshape(n_cols, r.n).T, np.frombuffer(r.y), np.frombuffer(r.w),
                   np.frombuffer(r.score).reshape(r.n, width))).persist(StorageLevel.MEMORY_AND_DISK)


def _added(parts, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays (3, leaves, ...) of all tasks."""
    size = 8 * int(np.prod(shape))
    if parts.getNumPartitions() * size <= GATHER_BYTES:
        return sum(parts.collect(), np.zeros(shape))
    pieces = parts.flatMap(lambda a: [(i, a[:, i]) for i in range(a.shape[1])])
    out = np.zeros(shape)
    for i, total in pieces.reduceByKey(lambda a, b: a + b, min(shape[1], parts.getNumPartitions())).collect():
        out[:, i] = total
    return out


def fit(df: DataFrame, cols: list[str], label: str, p: Params, weight: str | None = None) -> Booster:
    """Fit on all rows of ``df`` whose label is not null; NULL and NaN features are missing."""
    df = df.where(F.col(label).isNotNull())
    edges = edges_of(df, cols, p.bins)
    wanted_weight = F.lit(1.0) if weight is None else F.col(weight)
    total = df.agg(F.sum(F.col(label).cast("double") * wanted_weight).alias("y"), F.sum(wanted_weight).alias("w")).first()
    base = base_scores(p, np.array([total.y or 0.0]), float(total.w or 0.0))
    return _passes(_staged(df, cols, label, weight, edges, base, p.trees_a_round), Booster(p, list(cols), edges, base, []))


def _passes(blocks: DataFrame, model: Booster, rest: int = 0) -> Booster:
    """The trees of a model without any, from the staged blocks."""
    from pyspark import StorageLevel
    p, n_cols, width, base, edges = model.params, len(model.cols), model.params.trees_a_round, model.base, model.edges
    starts, widths = _starts(blocks), _widths(edges)
    state, since = _held(blocks, starts, n_cols, width), 0
    for number, trees in _generations(p):
        allowed = _generation_params(p, number, n_cols, trees)
        if p.objective != "forest" and model.generations:
            if width * (number - since) >= STAGE_TREES:
                written = _rescored(blocks, model, since, n_cols, width)
                state.unpersist()
                drop_paths(blocks.sparkSession, [blocks.inputFiles()[0].rsplit("/", 1)[0]])
                blocks, since = written, number
                state = _held(blocks, starts, n_cols, width)
            else:
                state, before = _with_scores(state, Booster(p, model.cols, edges, base, model.generations[-1:])), state
                state.persist(StorageLevel.MEMORY_AND_DISK)

        def measure(grown: list[Tree], wanted: list[tuple[int, int]]) -> np.ndarray:
            numbers, shape = _numbers(grown, wanted), (3, len(wanted), n_cols, 256)

            def partial(held):
                sums = np.zeros(shape)
                for place, bins, y, w, score in held:
                    g, h, c = _weighted(p, number, trees, place, score, y, w)
                    _add_histogram(sums, Codes(bins, widths), bins, g, h, c, grown, numbers, allowed)
                yield sums

            return _added(state.mapPartitions(partial), shape)

        first = measure([Tree() for _ in range(trees)], [(k, 0) for k in range(trees)])
        if p.objective != "forest" and number > since:
            before.unpersist()
        totals = [tuple(first[:, k, int(np.argmax(allowed[k]))].sum(axis=1)) for k in range(trees)]

        def known(grown: list[Tree], wanted: list[tuple[int, int]]) -> np.ndarray:
            """Histograms of the wanted leaves; those of the roots are there already."""
            if all(node == 0 for _, node in wanted):
                return first[:, [k for k, _ in wanted]]
            return measure(grown, wanted)

        model.generations.append(grow(trees, totals, _Sisters(known, n_cols, p), p, 1.0 if p.objective == "forest" else p.rate, rest))
    state.unpersist()
    return model


def _starts(blocks: DataFrame) -> dict[int, int]:
    """The number of each block's first row, in the order of the staged rows."""
    sizes = sorted((r.block, r.n) for r in blocks.select("block", "n").collect())
    return dict(zip((b for b, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))


def _with_scores(state, part: Booster):
    """The held blocks with the outputs of the trees of ``part`` added to their scores."""
    return state.map(lambda r: (*r[:4], part.raw_bins(r[1], 0, r[4])))


def _rescored(blocks: DataFrame, model: Booster, start: int, n_cols: int, width: int) -> DataFrame:
    """The staged blocks with the outputs of all generations from ``start`` on in their scores."""
    part = Booster(model.params, model.cols, model.edges, model.base, model.generations[start:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins = np.frombuffer(r["bins"], np.uint8).reshape(n_cols, r["n"]).T
                made = part.raw_bins(bins, 0, np.frombuffer(r["score"]).reshape(r["n"], width))
                yield _block([r["block"]], [r["n"]], [r["bins"]], [r["y"]], [r["w"]], [made.tobytes()])

    return materialize(blocks.mapInArrow(run, BLOCKS))


# --- forests --------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees of a forest that stay in storage: ``tops``, and of each leaf of a top the tree below
    it in ``parts`` (tree, leaf, made)."""

    params: Params
    cols: list[str]
    edges: list[np.ndarray]
    tops: list[Tree]
    parts: DataFrame
    fill: np.ndarray | None = None

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return to_bins(x if self.fill is None else np.where(np.isnan(x), self.fill, x), self.edges)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees' values, of a matrix and a forest that one host can hold."""
        bins, score = self._bins(x), np.zeros((len(x), 1))
        for tree, leaf, part in sorted(((r.tree, r.leaf, pickle.loads(r.made)) for r in self.parts.collect()), key=lambda r: r[:2]):
            r = np.flatnonzero(self.tops[tree].route(bins) == leaf)
            score[r, 0] += part.value[part.route(bins[r])]
        return score

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees' values.  Rows go to the trees, as blocks of bins."""
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        units, tops, n_cols = _units(self.tops), self.tops, len(self.cols)
        wanted = [np.full(len(t.left), -1, np.int64) for t in tops]
        for i, (tree, leaf) in enumerate(units):
            wanted[tree][leaf] = i
        names = ["unit", "block", "n", "made", "at"]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("_row").to_numpy(zero_copy_only=False)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, n_cols)
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):     # rows without a gap
                    if not len(part):
                        continue
                    bins = self_bins(x[part])
                    for tree, top in enumerate(tops):
                        place = wanted[tree][top.route(bins)]
                        for unit in np.unique(place):
                            at = np.flatnonzero(place == unit).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([
                                pa.array([unit], pa.int32()), pa.array([ids[part[0]]], pa.int64()), pa.array([len(part)], pa.int32()),
                                pa.array([bins[at].T.tobytes()], pa.binary()), pa.array([at.tobytes()], pa.binary())], names)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for b in batches:
                for r in b.to_pylist():
                    if r["at"] is None:
                        tree = pickle.loads(r["made"])
                        continue
                    bins = np.frombuffer(r["made"], np.uint8).reshape(n_cols, -1).T
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["unit"]], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([r["n"]], pa.int32()),
                        pa.array([tree.value[tree.route(bins)].tobytes()], pa.binary()), pa.array([r["at"]], pa.binary())], names)

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(pdf["n"].iloc[0])
            for made, at in pdf.sort_values("unit")[["made", "at"]].itertuples(index=False):        # in the trees' order
                total[np.frombuffer(at, np.int32)] += np.frombuffer(made)
            return pd.DataFrame({"_row": pdf["block"].iloc[0] + np.arange(len(total)), out: total / max(1, len(tops))})

        self_bins, schema = self._bins_of(), "unit int, block long, n int, made binary, at binary"
        numbered = df.sparkSession.createDataFrame([(*u, i) for i, u in enumerate(units)], "tree int, leaf int, unit int")
        trees = self.parts.join(numbered, ["tree", "leaf"]).select("unit", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("n"), "made",
                                                                   F.lit(None).cast("binary").alias("at"))
        blocks = rows.select("_row", F.array(*[F.col(c).cast("double") for c in self.cols]).alias("x")).mapInArrow(pack, schema)
        made = _met(trees.unionByName(blocks), len(units), "block").mapInArrow(score, schema)
        scores = materialize(made.groupBy("block").applyInPandas(add, f"_row long, {out} double"))
        return rows.join(scores, "_row").select(*df.columns, out)

    def _bins_of(self) -> Callable[[np.ndarray], np.ndarray]:
        """``_bins`` without the table of trees, for tasks."""
        return replace(self, tops=[], parts=None)._bins


def _units(tops: list[Tree]) -> list[tuple[int, int]]:
    """Every (tree, leaf) of the tops."""
    return [(k, node) for k, t in enumerate(tops) for node, left in enumerate(t.left) if left < 0]


def _met(rows: DataFrame, units: int, order: str) -> DataFrame:
    """The rows of a unit one after the other in one task, by ``order``."""
    tasks = min(units, 2 * rows.sparkSession.sparkContext.defaultParallelism) if units <= 4096 else units
    return rows.repartitionById(max(1, tasks), F.col("unit") % max(1, tasks)).sortWithinPartitions("unit", order)


def fit_forest(df: DataFrame, cols: list[str], label: str, p: Params, weight: str | None = None) -> Forest:
    """Passes split nodes until one has no more than ``FOREST_CELLS`` values; its rows then go to a
    task, which grows the rest of the tree.  The trees are those of :func:`fit_arrays`."""
    cols = list(cols)
    edges = edges_of(df, cols, p.bins)
    blocks = _staged(df, cols, label, weight, edges, np.zeros(1), 1)
    starts = _starts(blocks)
    if not starts:
        raise ValueError("no rows to fit on")
    n_cols, rest = len(cols), FOREST_CELLS // max(1, len(cols))
    if blocks.agg(F.sum("n")).first()[0] > rest:
        tops = [t for g in _passes(blocks, Booster(p, cols, edges, np.zeros(1), []), rest).generations for t in g]
    else:
        tops = [Tree() for _ in range(p.rounds)]
    units = _units(tops)
    wanted = [np.full(len(t.left), -1, np.int64) for t in tops]
    for i, (tree, leaf) in enumerate(units):
        wanted[tree][leaf] = i
    schema, names = "unit int, start long, bins binary, y binary, w binary, c binary", ["unit", "start", "bins", "y", "w", "c"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins = np.frombuffer(r["bins"], np.uint8).reshape(n_cols, r["n"]).T
                y, w = np.frombuffer(r["y"]), np.frombuffer(r["w"])
                for number, trees in _generations(p):
                    counts = _row_weights(p, number, trees, (r["block"], starts[r["block"]]), r["n"])
                    for k in range(trees):
                        tree = number * FOREST_BATCH + k
                        place = np.where(counts[:, k] > 0, wanted[tree][tops[tree].route(bins)], -1)
                        for unit in np.unique(place[place >= 0]):
                            at = np.flatnonzero(place == unit)
                            yield pa.RecordBatch.from_arrays([
                                pa.array([unit], pa.int32()), pa.array([starts[r["block"]]], pa.int64()),
                                *[pa.array([v.tobytes()], pa.binary()) for v in (bins[at].T, y[at], w[at], counts[at, k].astype(np.uint8))]], names)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, held in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["unit"]):
            held = list(held)
            tree, leaf = units[unit]
            number, k = divmod(tree, FOREST_BATCH)
            y, w, c = (np.concatenate([np.frombuffer(r[v], kind) for r in held]) for v, kind in (("y", float), ("w", float), ("c", np.uint8)))
            bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(n_cols, -1) for r in held], axis=1).T
            allowed = _generation_params(p, number, n_cols, min(FOREST_BATCH, p.rounds - number * FOREST_BATCH))[k]
            made = _forest_tree(bins, y, w, c.astype(float), allowed, p, p.depth - tops[tree].depth[leaf] if p.depth else None)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([leaf], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())],
                                             ["tree", "leaf", "made"])

    parts = materialize(_met(blocks.mapInArrow(deal, schema), len(units), "start").mapInArrow(train, "tree int, leaf int, made binary"))
    return Forest(p, cols, edges, tops, parts)
