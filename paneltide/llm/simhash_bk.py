"""SimHash near-duplicates linked through BK-trees.

A document's 64-bit fingerprint comes from its word shingles.  Two fingerprints
link when at most ``radius`` bits differ; documents with links, direct or through
others, form one component.

1. Distinct fingerprints only: exact copies meet in one ``groupBy``.
2. Shards by the pigeonhole: a fingerprint is cut to ``radius + 2`` blocks.  Two that
   link agree in at least two of them, so they share the shard of that pair of
   blocks.  A shard with more than ``SHARD`` members is cut again by pairs of blocks
   of the bits that are still free; what then shares a shard differs in 16 bits at
   most for radius 2, so a shard never holds more than 65,536 fingerprints, whatever
   the corpus.
3. In each shard a BK-tree is built (children keyed by their integer Hamming distance
   to the parent), and every member follows only the edges within the radius.
   Trees are built where their shard's members are, so no tree is sent to tasks
   whose fingerprints cannot match it.
4. A shard reports each linked member once, with the smallest member it reaches.
5. Components come from rounds of contraction over those links; each round is
   written to the shared folder.

Edge cases: null and empty text, or text without words, has fingerprint zero and
links like any other; texts shorter than a shingle hash whole; repeated rows
share their component; a null id belongs to its text's component but never names
it (component_id is null only if no member has an id); an empty table gives no
rows; further columns are ignored by :func:`components` and kept by
:func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.session import materialize

from .common import sheltered

#: members of a shard above which it is cut a second time
SHARD = 2048
#: (query, node) pairs followed at once while trees are searched
FRONTIER = 1 << 18


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash over the XXH64 (seed 42) of the k-word shingles, as unsigned 64 bits."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < k:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[:len(words) - k + 1].tolist()
    stop = (end - 1)[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(start, stop)], np.uint64)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``fp``, the fingerprint as a long."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    schema = T.StructType([docs.schema[c] for c in keep]).add("fp", T.LongType())
    need = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps)], [*keep, "fp"])

    return docs.select(*need).mapInArrow(run, schema)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _cuts(bits: list[int], parts: int) -> list[int]:
    """Bit masks of ``parts`` blocks of nearly equal size over the given bits."""
    return [sum(1 << b for b in block.tolist()) for block in np.array_split(bits, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pair_masks(bits: list[int], radius: int) -> list[int]:
    return [a | b for a, b in combinations(_cuts(bits, radius + 2), 2)]


def shard_keys(fps: DataFrame, radius: int) -> DataFrame:
    """(shard key, fp): every pair of linked fingerprints shares at least one key."""
    first = _pair_masks(list(range(64)), radius)

    def keyed(masks: list[int]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                         for i, m in enumerate(masks)))

    wide = fps.select("fp", F.explode(keyed(first)).alias("s")).select("fp", "s.pair", "s.bits")
    large = materialize(wide.groupBy("pair", "bits").count().where(F.col("count") > SHARD).select("pair", "bits"))
    small = wide.join(large, ["pair", "bits"], "left_anti").select("fp", "pair", F.lit(-1).alias("cut"), "bits")
    second = F.lit(None)
    for i, m in enumerate(first):
        free = [b for b in range(64) if not m >> b & 1]
        second = F.when(F.col("pair") == i, keyed([m | x for x in _pair_masks(free, radius)])).otherwise(second)
    deep = (wide.join(large, ["pair", "bits"], "left_semi")
            .select("fp", "pair", F.explode(second).alias("s"))
            .select("fp", "pair", F.col("s.pair").alias("cut"), F.col("s.bits").alias("bits")))
    return small.unionByName(deep)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def bk_trees(fps: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once.  ``shard`` is sorted; the first member of each
    is its root.  Returns (roots, edge, child): edges are sorted by the key
    ``parent * 65 + distance`` and lead to ``child``."""
    n = len(fps)
    roots = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
    here = np.repeat(roots, np.diff(np.append(roots, n)))  # the node each member has come down to
    down = np.setdiff1d(np.arange(n), roots, assume_unique=True)
    edges, children = [], []
    while len(down):
        key = here[down] * 65 + _distance(fps[down], fps[here[down]])
        found, first, back = np.unique(key, return_index=True, return_inverse=True)
        edges.append(found)
        children.append(down[first])  # the first to arrive becomes the child
        here[down] = down[first][back]
        down = np.delete(down, first)
    edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    at = np.argsort(edge)
    return roots, edge[at], child[at]


def _roots_of(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; every member points to its smallest."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots_of(label)
    return label


def linked(fps: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each member the index of the first member of its shard it reaches by links."""
    n = len(fps)
    roots, edge, child = bk_trees(fps, shard)
    root = np.repeat(roots, np.diff(np.append(roots, n)))
    label = np.arange(n)
    step = 1 << 14
    for at in range(0, n, step):
        stack = [(np.arange(at, min(n, at + step)), root[at:at + step])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = _distance(fps[q], fps[node])
            near = (d <= radius) & (q != node)
            label = _merge(label, q[near], node[near])
            lo = np.searchsorted(edge, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(edge, node * 65 + np.minimum(d + radius, 64), "right")
            width = hi - lo
            if width.any():
                inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
                stack.append((np.repeat(q, width), child[np.repeat(lo, width) + inner]))
    return label


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # members of the last, possibly unfinished shard
        for b in _then_none(batches):
            if b is None:
                now, rest = rest, None
            else:
                cols = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "cut", "bits", "fp")]
                both = np.stack(cols) if rest is None else np.hstack([rest, np.stack(cols)])
                same = (both[:3] == both[:3, -1:]).all(axis=0)
                last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                now, rest = both[:, :last], both[:, last:]
            if now is None or now.shape[1] < 2:
                continue
            new = np.concatenate(([True], (now[:3, 1:] != now[:3, :-1]).any(axis=0)))
            shard = np.cumsum(new)
            more = (np.bincount(shard) > 1)[shard]  # members that are alone have no links
            if not more.any():
                continue
            fps = now[3, more]
            label = linked(fps.view(np.uint64), shard[more], radius)
            far = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(fps[far]), pa.array(fps[label[far]])], ["a", "b"])
    return run


def _then_none(batches):
    yield from batches
    yield None


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that link;
    linear in the members of the shards, never all pairs."""
    keys = shard_keys(fps, radius).repartition("pair", "cut", "bits")
    return keys.sortWithinPartitions("pair", "cut", "bits", "fp").mapInArrow(_search(radius), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of one component share a label.  Each round every node
    joins its neighbour of smallest hash and the graph contracts; nodes are in
    random order by their hash, so rounds grow with the logarithm of the path length."""
    edges = materialize(edges)
    start = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    rounds = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), "b")).alias("m"))
        step = materialize(near.select("a", F.when(F.col("m.rank") < F.xxhash64("a"), F.col("m.b")).otherwise(F.col("a")).alias("to")))
        rounds.append(step)
        to_a = step.select("a", F.col("to").alias("x"))
        to_b = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(to_a, "a").join(to_b, "b").where(F.col("x") != F.col("y"))
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = start.withColumn("label", F.col("node"))
    for step in rounds:
        out = (out.join(step.select(F.col("a").alias("label"), "to"), "label", "left")
               .select("node", F.coalesce("to", "label").alias("label")))
    return out


def component_of(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, label) for the fingerprints of ``marked`` that link to another one."""
    return connected(links(marked.select("fp").distinct(), radius))


def components(docs: DataFrame, radius: int = 2, k: int = 3, key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable)."""
    marked = materialize(with_fingerprint(docs, k=k, keep=[key]))
    label = component_of(marked, radius)
    ids = marked.groupBy("fp").agg(F.min(key).alias("first"))
    of = (ids.join(label, ids.fp == label.node, "left")
          .select("fp", "first", F.coalesce("label", "fp").alias("label"), F.col("label").isNotNull().alias("many")))
    least = of.where("many").groupBy("label").agg(F.min("first").alias("least"))
    of = of.join(least, "label", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(of, "fp").select(key, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2, k: int = 3, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key (nulls
    last); of rows that share it, one."""
    inner, restored = sheltered(docs, [key, "text"])
    row = "_row"
    staged = materialize(with_fingerprint(inner.withColumn(row, F.monotonically_increasing_id()), k=k))
    label = component_of(staged, radius)
    order = F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), F.col(row).alias("row"))
    groups = staged.groupBy("fp").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    groups = groups.join(label, groups.fp == label.node, "left").select("fp", "n", "best", F.coalesce("label", "fp").alias("label"), F.col("label").isNotNull().alias("many"))
    best = groups.where("many").groupBy("label").agg(F.min("best").alias("of_all"))
    stays = (groups.where("many or n > 1").join(best, "label", "left")
             .select("fp", F.coalesce("of_all", "best")["row"].alias("stays")))
    goes = staged.select("fp", row).join(stays, "fp").where(F.col(row) != F.col("stays")).select(row)
    return restored(staged.join(goes, row, "left_anti"))
