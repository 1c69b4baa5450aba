"""Exact top-k by inner product with no-random-access aggregation.

Each dimension of a shard of candidates is a list sorted by component.  For a
query the lists are read sequentially, from the top where its component is
positive and from the bottom where it is negative.  What has been read gives
every candidate a lower bound (unread components at the list's worst value) and
an upper bound (at the last value read).  Reading stops for a query when no
candidate outside can qualify, and the final scores of the ones that may are
resolved.

Lists are read in growing blocks and all queries of a block share the reads, so
both bounds are matrix products of what has been read with the queries.

Work is split into cells of one candidate shard by one query block, both of
bounded size; each cell returns at most k rows per query, and a ranking over
those gives the result.  No cell depends on another, and none holds more than
``SHARD`` candidates and ``BLOCK`` queries.

Edge cases: vectors that are null or hold null, NaN or infinite components, or components
whose integer leaves +-2**53, take no part (neither as query nor as candidate); scores are
exact and ranked at any size, and one beyond a long is null in the result; rows that share a vec_id count once, with the
smallest vector; a null vec_id takes no part; shorter vectors end in zeros; ties go
to the smaller vec_id; fewer candidates than k give fewer rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096
BLOCK = 512
SCALE = 256

#: integers of components are exact as doubles below this
LARGEST = float(1 << 53)

FOUND = "query_id long, vec_id long, score decimal(38,0)"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and ``ints``: floor(256 * x) of each component, usable rows only."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST / SCALE)))
    one = vectors.select("vec_id", "embedding").where(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("ints"))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _number(a: np.ndarray, limit: float):
    """Exact arithmetic: doubles while every sum stays below 2**53, else Python ints."""
    return a.astype(np.float64) if limit < 2**52 else a.astype(object)


def nra_cell(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> list[tuple]:
    """Top k candidates of each query: (query id, candidate id, score) rows."""
    n, dims = c.shape
    limit = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1)
    q, c = _number(q, limit), _number(c, limit)
    order = np.argsort(c, axis=0, kind="stable")
    place = np.empty_like(order)  # where each candidate stands in each list
    np.put_along_axis(place, order, np.arange(n)[:, None].repeat(dims, 1), axis=0)
    asc = np.take_along_axis(c, order, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # read from the top, from the bottom
    worst = up @ asc[0] + down @ asc[-1] if n else None
    out: list[tuple] = []
    open_q = np.arange(len(q))
    depth = max(n // 4, 4 * k)
    while len(open_q) and n:
        depth = min(depth, n)
        top, low = place >= n - depth, place < depth
        t, b = up[open_q], down[open_q]
        # lower bound: worst score, raised by what has been read
        lower = worst[open_q] + np.where(top, c - asc[0], 0) @ t.T + np.where(low, c - asc[-1], 0) @ b.T
        # upper bound: unread components are at most the last value read
        last_top, last_low = asc[n - depth], asc[depth - 1]
        upper = t @ last_top + b @ last_low + np.where(top, c - last_top, 0) @ t.T + np.where(low, c - last_low, 0) @ b.T
        own = cid[:, None] == qid[open_q]
        lower[own] = -np.inf
        at = max(n - k, 0)  # the k-th largest lower bound
        bar = np.partition(lower, at, axis=0)[at] if limit < 2**52 else np.sort(lower, axis=0)[at]
        may = (upper >= bar) & ~own
        few = may.sum(axis=0) <= max(4 * k, n // 64)
        done = few | (depth == n)
        for j in np.flatnonzero(done):
            at = np.flatnonzero(may[:, j])
            i = open_q[j]
            score = c[at] @ q[i]  # resolve the final scores
            best = np.lexsort((cid[at], -score))[:k]
            out += [(int(qid[i]), int(cid[at[x]]), int(score[x])) for x in best]
        open_q = open_q[~done]
        depth *= 2
    return out


def _cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    width = max(map(len, pdf["ints"]), default=0)
    is_q = pdf["is_query"].to_numpy(bool)
    both = _matrix(pdf["ints"], width)
    ids = pdf["vec_id"].to_numpy(np.int64)
    c, cid = both[~is_q], ids[~is_q]
    rows = nra_cell(both[is_q], ids[is_q], c, cid, k) if is_q.any() and len(c) else []
    made = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})
    made["score"] = [Decimal(v) for v in made["score"]]
    return made


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query."""
    v = quantised(vectors)
    n = v.select(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // SHARD)), max(1, -(-n["q"] // BLOCK))
    spread = F.xxhash64("vec_id")
    cells = (v.withColumn("is_query", F.lit(False)).withColumn("shard", F.pmod(spread, F.lit(shards)))
             .withColumn("block", F.explode(_numbers(blocks)))
             .unionByName(v.where(is_query).withColumn("is_query", F.lit(True))
                          .withColumn("shard", F.explode(_numbers(shards)))
                          .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _cell(pdf, k)

    found = cells.groupBy("shard", "block").applyInPandas(run, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.expr("try_cast(score as bigint)").alias("score")))
