"""Substring dedup with suffix automata of reference shards.

A window is ``length`` consecutive words of a document.  Every word is removed that a
window covers whose word sequence also starts in a document of smaller id.

Sending the automaton of every shard of the corpus past every document would cost
documents times shards.  Shards are therefore cut so that a window can only match in
one of them:

1. The anchor of a window is the smallest hash among its ``ANCHOR``-word grams: a
   function of the window's words alone, so equal windows share their anchor wherever
   they stand.  Consecutive windows of one anchor are a run, at most a few dozen words.
2. Anchors that stand in one document only are dropped; what stays is the repeated
   part of the corpus.  Runs of equal content are one reference with the smallest id that
   holds it (pre-aggregated in the tasks, so a passage in a third of all documents is
   one row per task).
3. The references of one anchor are a shard.  In order of document id each is streamed
   against the suffix automaton of those of smaller ids; its matching statistics say
   which windows occur there.  Then it is added to the automaton.  Shards of more than
   ``SHARD`` references are settled exactly by grouping their windows instead.
4. Marked windows go back to the documents, which drop the maximal spans they cover.

Windows are judged on the input, not on what is left.

Edge cases: null text has no words; texts shorter than a window lose nothing; rows of
one doc_id (repeated rows, or different texts under one id) never remove from
each other; rows with a null doc_id lose nothing and remove nothing; an empty
table gives no rows; further columns are kept by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.session import materialize

from .common import GRAM_MULT, SPACED, gram_hashes, mix, sheltered, slices, utf8, within_rows, word_hashes, word_spans

LENGTH = 50
#: words of an anchor gram
ANCHOR = 16
#: references of one anchor that meet in one automaton
SHARD = 1024


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - have:]) if have < width else out


class Runs:
    """Runs of windows with one anchor, over the rows of a batch."""

    def __init__(self, column: pa.Array, length: int):
        data, offsets = utf8(column)
        starts, ends, self.first = word_spans(data, offsets, SPACED)
        self.words = wh = word_hashes(data, starts, ends)
        anchor = min(ANCHOR, length)
        inside = within_rows(self.first, length)
        if not inside.any():
            self.row = self.start = self.n = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        low = sliding_min(gram_hashes(wh, anchor), length - anchor + 1)
        at = np.flatnonzero(inside)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[at]
        a = low[at]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])))
        head = np.flatnonzero(new)
        self.n = np.diff(np.append(head, len(at)))
        self.anchor, self.row = a[head], row[head]
        self.start = at[head] - self.first[self.row]

    def content(self, length: int) -> np.ndarray:
        """A hash of each run's words."""
        wh = self.words
        inverse = pow(int(GRAM_MULT), -1, 2**64)
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(wh), GRAM_MULT, np.uint64))))
        back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(wh), inverse, np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wh * power[:-1], dtype=np.uint64)))
        a = self.first[self.row] + self.start
        return mix((total[a + self.n + length - 1] - total[a]) * back[a])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r = Runs(part.column("text"), length)
                ids = part.column("_id").to_numpy(zero_copy_only=False)[r.row]
                order = np.lexsort((ids, r.anchor))
                a, ids = r.anchor[order], ids[order]
                head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
                last = np.append(head[1:], len(a)) - 1 if len(a) else head
                yield pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array(ids[head], pa.int64()), pa.array(ids[last], pa.int64())],
                                                 ["anchor", "low", "high"])
    return run


def _run_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r = Runs(part.column("text"), length)
                at = pa.array(r.row)
                content = r.content(length) if len(r.row) else r.anchor
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column("_id").take(at),
                     part.column("_th").take(at), pa.array(r.start, pa.int32()), pa.array(r.n, pa.int32())],
                    ["anchor", "content", "_id", "_th", "start", "n"])
    return run


RUNS = "anchor long, content long, _id long, _th long, start int, n int"


def _cut(length: int):
    """Words of the wanted runs of each document, as hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, ends, first = word_spans(data, offsets, SPACED)
                wh = word_hashes(data, starts, ends).view(np.int64)
                out: list[list] = [[], [], [], [], []]
                for i, wanted in enumerate(part.column("wanted").to_pylist()):
                    for w in wanted:
                        a = first[i] + w["start"]
                        for c, v in zip(out, (w["anchor"], w["content"], w["n"], w["low"], wh[a:a + w["n"] + length - 1])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()),
                     pa.array(out[4], pa.list_(pa.int64()))], ["anchor", "content", "n", "low", "words"])
    return run


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes."""

    def __init__(self):
        self.to: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words: list[int]) -> None:
        to, link, length = self.to, self.link, self.len
        last = 0
        for w in words:
            q = to[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, q, w)
                continue
            cur = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in to[p]:
                to[p][w] = cur
                p = link[p]
            if p >= 0:
                q = to[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: int) -> int:
        to, link, length = self.to, self.link, self.len
        c = len(to)
        to.append(dict(to[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and to[p].get(w) == q:
            to[p][w] = c
            p = link[p]
        return c

    def matching(self, words: list[int]) -> list[int]:
        """Length of the longest match that ends at each word."""
        to, link, length = self.to, self.link, self.len
        out, s, n = [], 0, 0
        for w in words:
            while s and w not in to[s]:
                s = link[s]
                n = length[s]
            nxt = to[s].get(w)
            s, n = (nxt, n + 1) if nxt is not None else (0, 0)
            out.append(n)
        return out


def _settle(length: int):
    """Windows of each reference that occur in references of smaller ids (rows come
    sorted by anchor and id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, low, automaton, waiting = None, None, None, []
        for batch in batches:
            keep: list[tuple] = []
            for a, c, n, id_, words in zip(*(batch.column(x).to_pylist() for x in ("anchor", "content", "n", "low", "words"))):
                if a != anchor:
                    anchor, low, automaton, waiting = a, id_, None, []
                elif id_ != low:
                    automaton = automaton or SuffixAutomaton()
                    for w in waiting:
                        automaton.add(w)
                    low, waiting = id_, []
                if automaton is not None:
                    seen = [m >= length for m in automaton.matching(words)[length - 1:]]
                    if any(seen):
                        keep.append((a, c, n, seen))
                waiting.append(words)
            cols = list(zip(*keep)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.bool_())))],
                                             ["anchor", "content", "n", "seen"])
    return run


def _windows(length: int):
    """(anchor, content, n, place, hash, second hash, low) of each window of a reference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for a, c, n, low, words in zip(*(b.column(x).to_pylist() for x in ("anchor", "content", "n", "low", "words"))):
                w = np.array(words, np.int64).view(np.uint64)
                one, two = gram_hashes(w, length).view(np.int64), gram_hashes(mix(w.copy()), length).view(np.int64)
                for col, v in zip(out, ([a] * n, [c] * n, [n] * n, range(n), one, two, [low] * n)):
                    col.extend(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["anchor", "content", "n", "place", "one", "two", "low"])
    return run


SEEN = "anchor long, content long, n int, seen array<boolean>"
WORDS = "anchor long, content long, n int, low long, words array<long>"
WINDOWS = "anchor long, content long, n int, place int, one long, two long, low long"


def _removal(keep: list[str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                n_words, n_removed, kept = [], [], []
                for t, marks in zip(texts, part.column("marks").to_pylist()):
                    words = (t or "").encode().split()  # bytes: ASCII white space alone
                    gone = np.zeros(len(words) + 1, np.int64)
                    for m in marks or ():
                        at = m["start"] + (np.arange(m["n"]) if m["seen"] is None else np.flatnonzero(m["seen"]))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + length, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone) if not g] if gone.any() else words))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept"])
    return run


def marks(docs: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """(_id, _th, marks): the windows to remove, per document id and text hash; a mark
    is a run of ``n`` windows from word ``start``, all of them or those ``seen``."""
    read = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    repeated = materialize(read.select("_id", "text").mapInArrow(_anchors(length), "anchor long, low long, high long")
                           .groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                           .where("low < high").select("anchor"))
    runs = materialize(read.mapInArrow(_run_rows(length), RUNS).join(repeated, "anchor"))
    of = ["anchor", "content", "n"]
    refs = materialize(runs.groupBy(*of).agg(F.min(F.struct("_id", "_th", "start")).alias("r"))
                       .select(*of, F.col("r._id").alias("low"), "r._th", "r.start"))
    size = materialize(refs.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1"))
    wanted = (refs.join(size, "anchor")
              .groupBy(F.col("low").alias("_id"), "_th").agg(F.collect_list(F.struct(*of, "low", "start", "size")).alias("wanted")))
    # one text per id and hash: repeated rows are the same text
    cut = materialize(read.join(wanted, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("text", "wanted")
                      .mapInArrow(_cut(length), WORDS).join(size, "anchor"))
    in_shards = (cut.where(F.col("size") <= SHARD).drop("size").repartition("anchor").sortWithinPartitions("anchor", "low")
                 .mapInArrow(_settle(length), SEEN))
    wide = cut.where(F.col("size") > SHARD).drop("size").mapInArrow(_windows(length), WINDOWS)
    first = wide.groupBy("anchor", "one", "two").agg(F.min("low").alias("first"))
    in_windows = (wide.join(first, ["anchor", "one", "two"]).groupBy(*of)
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("first") < F.col("low")).alias("seen")))), lambda s: s["seen"]).alias("seen"))
                  .where(F.exists("seen", lambda s: s)))
    seen = in_shards.unionByName(in_windows)
    # written, so that the next join has a plain exchange on both sides and skewed runs split
    judged = materialize(refs.select(*of, "low").join(seen, of, "left"))
    return (runs.join(judged, of)
            .where("_id > low OR seen IS NOT NULL")
            .select("_id", "_th", F.struct("start", "n", F.when(F.col("_id") == F.col("low"), F.col("seen")).alias("seen")).alias("mark"))
            .groupBy("_id", "_th").agg(F.collect_list("mark").alias("marks")))


MADE = ["n_words", "n_removed", "kept"]


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with n_words, n_removed and ``kept`` (the words
    that stay, joined by one space); columns of the input with these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    inner, restored = sheltered(docs.select(*dict.fromkeys([*keep, key, "text"])), [key, "text"])
    schema = T.StructType(list(inner.schema.fields)).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType())
    left = inner.withColumn("_id", F.col(key).cast("long")).withColumn("_th", F.xxhash64("text"))
    made = left.join(marks(inner, length, key), ["_id", "_th"], "left").mapInArrow(_removal(inner.columns, length), schema)
    return restored(made, MADE).select(*keep, *MADE)
