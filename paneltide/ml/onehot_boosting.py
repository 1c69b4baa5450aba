"""Boosted trees on numbers and one-hot groups of any width, by the rules of Spark's ``GBTClassifier``.

Spark holds each row as an array over all features, so a one-hot category costs every row its
width.  Here a group is one number a row, the place that is set (:mod:`ml.onehot`); the sums of all
its columns come from one count over that number, and those of the rows where a column is not set
are what is left of the leaf.  The trees are the same: level by level, variance, the first one on
labels -1 and 1 with weight 1, the others on the gradient of the log loss with the learning
rate; a leaf's value is its mean; of equal gains the first column and lowest threshold wins.

A pass adds residual and row count per (leaf, column, bin or place): the root's while the scores
get the last tree's outputs, then of two sister leaves only the smaller; the other is what is left
of their parent.  The driver gets two numbers for each bin and place of an open leaf, however many
rows there are.  Rows are staged once as blocks and held by Spark with their scores, as in
:mod:`ml.boosting`; a table of a checked size is fitted by the same code in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_paths, materialize
from . import boosting

#: a number has about so many bins, by Spark's default ...
SPARK_BINS = 32
#: ... and fewer than these: two numbers share a 16 bit value, so that one count serves both
BINS, BITS = 64, 6
CELLS = BINS * BINS
#: Spark's trees take the thresholds of numbers from about so many rows (all rows are fitted) ...
EDGE_ROWS = 10000
#: ... drawn by this number, which they make from seed 42
EDGE_SEED = 444206279
#: values (rows x columns) up to which one task fits all rows; beyond, passes do
TASK_CELLS = 32 << 20
#: numbers of a piece of the sums that tasks add up
PIECE = 1 << 16
TIE = 1e-12


@dataclass(frozen=True)
class Rules:
    rounds: int = 100
    rate: float = 0.1
    depth: int = 3


@dataclass
class Tree:
    """Nodes in the order they were made; ``left`` = -1 marks a leaf, right is left + 1.  A row goes
    left if its bin is at most ``cut``; for a group, if its place is not ``cut``."""

    column: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int) -> None:
        self.column[node], self.cut[node], self.left[node] = column, cut, len(self.left)
        for part in (self.column, self.cut):
            part += [0, 0]
        self.left += [-1, -1]
        self.value += [0.0, 0.0]

    def route(self, b: Block, n_numbers: int) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(b.n, np.int16)
        for node, left in enumerate(self.left):
            if left < 0:
                continue
            r = slice(None) if node == 0 else np.flatnonzero(at == node)
            f = self.column[node]
            if f < n_numbers:
                v = b.pairs[f >> 1][r]
                right = (v & (BINS - 1) if f & 1 else v >> BITS) > self.cut[node]
            else:
                right = b.places[f - n_numbers][r] == self.cut[node]
            at[r] = left + right
        return at


@dataclass
class Block:
    """Rows as columns: bins of two numbers each, places of the groups, label -1 or 1, score."""

    pairs: np.ndarray
    places: np.ndarray
    y: np.ndarray
    score: np.ndarray

    @property
    def n(self) -> int:
        return len(self.y)

    @classmethod
    def of(cls, x: np.ndarray, places: np.ndarray, y: np.ndarray, edges: list[np.ndarray]) -> Block:
        bins = np.minimum(boosting.to_bins(x, edges), BINS - 1).T.astype(np.uint16)     # NaN: right of every cut
        if len(bins) & 1:
            bins = np.vstack([bins, np.zeros((1, len(y)), np.uint16)])
        return cls(bins[::2] << BITS | bins[1::2], np.ascontiguousarray(places.T, np.int32), y.astype(np.int8), np.zeros(len(y)))


@dataclass(frozen=True)
class Shape:
    """Where the sums of a leaf lie: a bin of each number, a place of each group, the whole leaf."""

    numbers: int
    widths: tuple[int, ...]

    @property
    def size(self) -> int:
        return self.numbers * BINS + sum(self.widths) + 1

    def groups(self) -> Iterator[tuple[int, int]]:
        at = self.numbers * BINS
        for w in self.widths:
            yield at, w
            at += w


def residuals(b: Block, first: bool) -> np.ndarray:
    """What the next tree is fitted to: the label, later the log loss's negative gradient."""
    if first:
        return b.y.astype(float)
    with np.errstate(over="ignore"):
        return 4.0 * b.y / (1.0 + np.exp(2.0 * b.y * b.score))


def sums_of(blocks: Iterator[Block], shape: Shape, tree: Tree, wanted: list[int], first: bool) -> np.ndarray:
    """(residual and rows, wanted leaf, bin or place) of some blocks."""
    k = len(wanted)
    n_pairs = (shape.numbers + 1) // 2
    cells, out = np.zeros((2, n_pairs, k * CELLS)), np.zeros((2, k, shape.size))
    number = np.full(len(tree.left), -1, np.int64)
    number[wanted] = np.arange(k)
    for b in blocks:
        r, place = residuals(b, first), number[tree.route(b, shape.numbers)]
        some = np.flatnonzero(place >= 0)
        every = len(some) == b.n
        if not every:
            r, place = r[some], place[some]
        pick = (lambda column: column) if every else (lambda column: column[some])  # noqa: E731,B023
        for i, column in enumerate(b.pairs):
            at = pick(column).astype(np.int64)
            if k > 1:
                at += place * CELLS
            cells[0, i] += np.bincount(at, r, k * CELLS)
            cells[1, i] += np.bincount(at, None, k * CELLS)
        for (begin, w), column in zip(shape.groups(), b.places):
            column = pick(column)
            has = column < w
            at = column[has] + place[has] * w
            out[0, :, begin:begin + w] += np.bincount(at, r[has], k * w).reshape(k, w)
            out[1, :, begin:begin + w] += np.bincount(at, None, k * w).reshape(k, w)
        out[0, :, -1] += np.bincount(place, r, k)
        out[1, :, -1] += np.bincount(place, None, k)
    cells = cells.reshape(2, n_pairs, k, BINS, BINS)
    for f in range(shape.numbers):
        out[:, :, f * BINS:(f + 1) * BINS] = cells[:, f >> 1].sum(axis=2 if f & 1 else 3)
    return out


def best_split(sums: np.ndarray, shape: Shape) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(column, cut, sums of the left and right rows) of the largest gain, if there is any."""
    whole = sums[:, -1]
    at = shape.numbers * BINS
    left = [np.cumsum(sums[:, :at].reshape(2, shape.numbers, BINS), axis=2).reshape(2, at), whole[:, None] - sums[:, at:-1]]
    left = np.concatenate(left, axis=1)
    right = whole[:, None] - left
    ok = (left[1] >= 0.5) & (right[1] >= 0.5)
    if not ok.any():
        return None
    halves = np.where(ok, left[0] ** 2 / np.maximum(left[1], 0.5) + right[0] ** 2 / np.maximum(right[1], 0.5), -np.inf)
    top = halves.max()
    if top - whole[0] ** 2 / whole[1] <= TIE * top:
        return None
    i = int(np.argmax(halves >= top - TIE * top))
    if i < at:
        return i // BINS, i % BINS, left[:, i], right[:, i]
    j = next(j for j, (begin, w) in enumerate(shape.groups()) if i < begin + w)
    return shape.numbers + j, i - list(shape.groups())[j][0], left[:, i], right[:, i]


def grow(root: np.ndarray, measure: Callable[[Tree, list[int]], np.ndarray], shape: Shape, depth: int, weight: float) -> Tree:
    """A tree from the sums of its root; ``measure`` makes those of other leaves."""
    tree, known = Tree(), {0: root}
    tree.value[0] = weight * root[0, -1] / root[1, -1]
    for level in range(depth):
        split = {}
        for node, sums in known.items():
            s = best_split(sums, shape)
            if s is not None:
                tree.split(node, *s[:2])
                split[node] = s[2:]
                for child, (g, n) in enumerate(s[2:], tree.left[node]):
                    tree.value[child] = weight * g / n
        if not split or level + 1 == depth:
            break
        less = {node: tree.left[node] + (b[1] < a[1]) for node, (a, b) in split.items()}
        found = measure(tree, list(less.values()))
        below = {}
        for i, (node, child) in enumerate(less.items()):
            rest = known[node] - found[:, i]
            rest[0, rest[1] < 0.5] = 0.0
            other = 2 * tree.left[node] + 1 - child
            below |= dict(sorted({child: found[:, i], other: rest}.items()))
        known = below
    return tree


def add_outputs(b: Block, trees: list[Tree], n_numbers: int) -> Block:
    score = b.score
    for t in trees:
        score = score + np.array(t.value)[t.route(b, n_numbers)]
    return Block(b.pairs, b.places, b.y, score)


# --- thresholds of numbers -------------------------------------------------------------------


def edges_of_values(v: np.ndarray, rows: float, bins: int) -> np.ndarray:
    """Thresholds halfway between values: all if few, else where the rows up to a value are
    nearest to a multiple of 1 / ``bins`` of all.  ``rows`` is how many values were to be drawn; as
    Spark counts zeros, they are those that the others leave."""
    v, c = np.unique(v[v != 0], return_counts=True)
    if len(v) and rows - c.sum() > 1e-10:
        at = int(np.searchsorted(v, 0.0))
        v, c = np.insert(v, at, 0.0), np.insert(c.astype(float), at, rows - c.sum())
    middle = (v[:-1] + v[1:]) / 2.0
    if len(v) <= bins:
        return middle
    stride = rows / bins
    out, target, run = [], stride, np.cumsum(c)
    for i in range(1, len(v)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def edge_rows(df: DataFrame, cols: list[str], n: int) -> np.ndarray:
    """The rows that thresholds come from: those that Spark's trees draw."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    if n > EDGE_ROWS:
        spark = df.sparkSession
        drawn = rows._jdf.toJavaRDD().sample(False, EDGE_ROWS / n, EDGE_SEED)
        rows = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    return np.array([r.x for r in rows.collect()], float).reshape(-1, len(cols))


# --- the fit ----------------------------------------------------------------------------------


@dataclass
class Booster:
    edges: list[np.ndarray]
    shape: Shape
    trees: list[Tree]

    def margin(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of scaled numbers and places: above 0 is the positive class."""
        b = Block.of(x, places, np.ones(len(x)), self.edges)
        return add_outputs(b, self.trees, self.shape.numbers).score


def fit_blocks(blocks: list[Block], edges: list[np.ndarray], shape: Shape, rules: Rules) -> Booster:
    """Fit on blocks that one task holds."""
    model = Booster(edges, shape, [])
    for number in range(rules.rounds):
        blocks = [add_outputs(b, model.trees[-1:], shape.numbers) for b in blocks]
        measure = lambda tree, wanted: sums_of(iter(blocks), shape, tree, wanted, number == 0)  # noqa: E731,B023
        model.trees.append(grow(measure(Tree(), [0])[:, 0], measure, shape, rules.depth, rules.rate if number else 1.0))
    return model


BLOCKS = "n int, pairs binary, places binary, y binary, score binary"


def _packed(df: DataFrame, edges: list[np.ndarray], shape: Shape) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                held.append(whole.slice(at, boosting.BLOCK_ROWS - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == boosting.BLOCK_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held)
        x, s = (b.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                for c, k in (("x", shape.numbers), ("s", len(shape.widths))))
        return _row(Block.of(x, s, b.column("y").to_numpy(), edges))

    return df.mapInArrow(pack, BLOCKS)


def _row(b: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b.n], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (b.pairs, b.places, b.y, b.score)]],
                                      [f.split()[0] for f in BLOCKS.split(", ")])


def _block(r, shape: Shape) -> Block:
    return Block(np.frombuffer(r["pairs"], np.uint16).reshape(-1, r["n"]), np.frombuffer(r["places"], np.int32).reshape(len(shape.widths), r["n"]),
                 np.frombuffer(r["y"], np.int8), np.frombuffer(r["score"]))


def _held(blocks: DataFrame, shape: Shape):
    """The staged blocks spread evenly over tasks, kept in Spark's storage."""
    from pyspark import StorageLevel
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("pairs") + F.length("places") + F.length("score")).alias("bytes")).first()
    tasks = max(1, min(size.blocks, max(blocks.sparkSession.sparkContext.defaultParallelism, -(-(size.bytes or 0) // boosting.TASK_BYTES))))
    return blocks.repartition(tasks).rdd.map(lambda r: _block(r, shape)).persist(StorageLevel.MEMORY_AND_DISK)


def _added(parts, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays of all tasks, added by tasks first where they are many or large."""
    size = int(np.prod(shape))
    n = parts.getNumPartitions()
    if n * size * 8 <= boosting.GATHER_BYTES:
        return sum(parts.collect(), np.zeros(shape))
    out = np.zeros(size)
    pieces = parts.flatMap(lambda a: [(i, a.ravel()[i:i + PIECE]) for i in range(0, size, PIECE)])
    for i, total in pieces.reduceByKey(lambda a, b: a + b, min(n, -(-size // PIECE))).collect():
        out[i:i + PIECE] = total
    return out.reshape(shape)


def _fit_over_tasks(rows: DataFrame, edges: list[np.ndarray], shape: Shape, rules: Rules) -> Booster:
    from pyspark import StorageLevel
    blocks = materialize(_packed(rows, edges, shape))
    model, state, since, before = Booster(edges, shape, []), _held(blocks, shape), 0, None
    for number in range(rules.rounds):
        if number and number - since >= boosting.STAGE_TREES:
            written = materialize(_rescored(blocks, model.trees[since:], shape))
            state.unpersist()
            drop_paths(rows.sparkSession, [blocks.inputFiles()[0].rsplit("/", 1)[0]])
            blocks, since = written, number
            state = _held(blocks, shape)
        elif number:
            last = model.trees[-1:]
            state, before = state.map(lambda b: add_outputs(b, last, shape.numbers)).persist(StorageLevel.MEMORY_AND_DISK), state  # noqa: B023

        def measure(tree: Tree, wanted: list[int]) -> np.ndarray:
            first = number == 0  # noqa: B023
            return _added(state.mapPartitions(lambda held: [sums_of(held, shape, tree, wanted, first)]), (2, len(wanted), shape.size))  # noqa: B023

        root = measure(Tree(), [0])
        if before is not None:
            before.unpersist()
            before = None
        model.trees.append(grow(root[:, 0], measure, shape, rules.depth, rules.rate if number else 1.0))
    state.unpersist()
    return model


def _rescored(blocks: DataFrame, trees: list[Tree], shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _row(add_outputs(_block(r, shape), trees, shape.numbers))

    return blocks.mapInArrow(run, BLOCKS)


def _fit_in_one_task(rows: DataFrame, edges: list[np.ndarray], shape: Shape, rules: Rules) -> Booster:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_block(r, shape) for b in batches for r in b.to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_blocks(held, edges, shape, rules))], pa.binary())], ["model"])

    return pickle.loads(_packed(rows, edges, shape).coalesce(1).mapInArrow(train, "model binary").first().model)


def fit(df: DataFrame, cols: list[str], groups: list[str], label: str, rules: Rules) -> Booster:
    """Fit on numbers and indices of groups (as wide as the largest index of ``df``): in one task
    while rows x columns stay within ``TASK_CELLS`` (counted), else by passes over all tasks."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isin(0, 1)).alias("labelled"), *[F.max(c).alias(f"w{i}") for i, c in enumerate(groups)]).first()
    if not size.n:
        raise ValueError("no rows to fit on")
    if size.labelled < size.n:
        raise ValueError(f"{size.n - size.labelled} labels are neither 0 nor 1")
    shape = Shape(len(cols), tuple(int(size[f"w{i}"]) + 1 for i in range(len(groups))))
    drawn = edge_rows(df, cols, size.n)
    edges = [edges_of_values(v, min(EDGE_ROWS, size.n), min(SPARK_BINS, size.n)) for v in drawn.T]
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.array(*[F.col(c).cast("int") for c in groups]).cast("array<int>").alias("s"),
                     (2 * F.col(label) - 1).cast("double").alias("y"))
    fitted = _fit_in_one_task if size.n * (len(cols) + len(groups)) <= TASK_CELLS else _fit_over_tasks
    return fitted(rows, edges, shape, rules)


class OneHotBoostedClassifier(Estimator):
    """The last stage of a pipeline: number columns, index columns (one-hot), a 0 / 1 label."""

    def __init__(self, cols: list[str], groups: list[str], label: str, rules: Rules):
        super().__init__()
        self.cols, self.groups, self.label, self.rules = list(cols), list(groups), label, rules

    def _fit(self, dataset: DataFrame) -> OneHotBoostedModel:
        return OneHotBoostedModel(self.cols, self.groups, fit(dataset, self.cols, self.groups, self.label, self.rules))


class OneHotBoostedModel(Model):
    """Adds rawPrediction, probability and prediction as Spark's classifiers do."""

    def __init__(self, cols: list[str], groups: list[str], booster: Booster):
        super().__init__()
        self.cols, self.groups, self.booster = cols, groups, booster

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model, shape = self.booster, self.booster.shape

        @F.pandas_udf("double")
        def margin(x: pd.Series, places: pd.Series) -> pd.Series:
            return pd.Series(model.margin(np.stack(x.to_numpy()), np.stack(places.to_numpy()).reshape(len(x), len(shape.widths))) if len(x) else np.zeros(0))

        m = margin(F.array(*[F.col(c).cast("double") for c in self.cols]), F.array(*[F.col(c).cast("int") for c in self.groups]).cast("array<int>"))
        p = 1.0 / (1.0 + F.exp(-2.0 * F.col("_margin")))
        return dataset.withColumn("_margin", m).withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))), "probability": array_to_vector(F.array(1.0 - p, p)),
            "prediction": F.when(F.col("_margin") > 0, 1.0).otherwise(0.0)}).drop("_margin")
