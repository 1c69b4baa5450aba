"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines); a paragraph is cut further behind words whose hash ends
in ``PIECE_BITS`` zero bits, so that a change moves no cut but those beside it.  Each piece gets a
64-bit digest of its words and of how often the text had it before.  A sketch of ``3 t`` cells
adds every digest to one cell of each third: a cell holds the number of its digests, their sum
and the sum of their check values.

Two versions are compared by subtracting their cells: what both hold cancels out, and cells
left with one digest are peeled, each freeing others, until the digests that differ are known.
Where peeling gets stuck the sketches are built again with twice the cells; equal positions
at every size mean equal digests, so some size always succeeds.  Likeness is the number of common
digests over that of all (Jaccard).  The fingerprint is the smallest sketch with the number of
pieces and a hash of the whole text: equal texts have equal fingerprints.

:func:`compare` does this for any table of version pairs, without a shuffle.  :func:`succeed`
brings every document together with its successor by one range shuffle of the texts: cut keys come
from a narrow pass over (doc_id, text hash), and the first row of a range is also sent to the
end of the range before.  Equal rows of a batch are sent as one with their number.

Edge cases: null text is empty; a text without a word has no pieces, and two of them are alike (1);
very long texts take larger sketches, nothing is cut off; rows of one doc_id follow each
other by text hash, so an equal row's successor is its copy; a null doc_id comes first; a
lone document succeeds itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.session import default_parallelism, materialize

from .common import SLICE_BYTES, SPACED, WORD_MULT, mix, utf8, word_hashes, word_spans

#: pieces have 2**PIECE_BITS words on average
PIECE_BITS = 3
#: cells of a third of the smallest sketch, which is the fingerprint
BASE = 4
THIRDS = 3
#: rounds of peeling at one size; what is left then takes the next size
ROUNDS = 200
#: rows of a range of documents, unless the session asks for more ranges
RANGE_ROWS = 1 << 16

_CHECK = np.uint64(0xA24BAED4963EE407)
_OCCURRENCE = np.uint64(0x9FB21C651E98DF25)


# --- digests -------------------------------------------------------------------------------


def piece_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every piece; the keys of one row are distinct."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = word_spans(data, offsets, SPACED)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = word_hashes(data, starts, ends)
    line = np.cumsum(data == 10)[starts]
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    cut = np.ones(len(words), bool)
    cut[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | ((words[:-1] & np.uint64((1 << PIECE_BITS) - 1)) == 0)
    at = np.flatnonzero(cut)
    place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
    power = np.full(int(place.max()) + 1, WORD_MULT, np.uint64)
    power[0] = 1
    digest = mix(np.add.reduceat(words * np.multiply.accumulate(power)[place], at))
    row = row[at]
    order = np.lexsort((digest, row))
    r, d = row[order], digest[order]
    new = np.ones(len(d), bool)
    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    before = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
    key = mix(d + (before + 1).astype(np.uint64) * _OCCURRENCE)
    order = np.lexsort((key, r))
    r, key = r[order], key[order]
    once = np.ones(len(r), bool)  # 64-bit accidents count once
    once[1:] = (r[1:] != r[:-1]) | (key[1:] != key[:-1])
    return r[once], key[once]


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _CHECK) >> np.uint64(32)).astype(np.uint32)


def _cells(keys: np.ndarray, third: int, t: int) -> np.ndarray:
    """The cell of each key in one third of a sketch with thirds of t cells (a power of 2)."""
    at = mix(keys + np.uint64((third + 1) * int(WORD_MULT) % 2**64)) & np.uint64(t - 1)
    return at.astype(np.int64) + third * t


class Sketches:
    """Cells of several sketches of one size: counts, sums of keys, sums of checks."""

    def __init__(self, n: int, t: int):
        self.t, self.width = t, THIRDS * t
        self.count = np.zeros(n * self.width, np.int64)
        self.keys = np.zeros(n * self.width, np.uint64)
        self.checks = np.zeros(n * self.width, np.uint32)

    def add(self, row: np.ndarray, keys: np.ndarray, sign=1) -> None:
        checks = _check(keys)
        if not np.isscalar(sign):
            checks, minus = np.where(sign > 0, checks, -checks), np.where(sign > 0, keys, -keys)
        else:
            minus = keys
        for third in range(THIRDS):
            at = row * self.width + _cells(keys, third, self.t)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, minus)
            np.add.at(self.checks, at, checks)

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """Sketch a[i] less sketch b[i] of every pair."""
        out = Sketches(0, self.t)
        for part in ("count", "keys", "checks"):
            cells = getattr(self, part).reshape(-1, self.width)
            setattr(out, part, (cells[a] - cells[b]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(done, row, key, sign): which sketches could be emptied, and the keys taken out."""
        found: list[tuple] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(ROUNDS):
            sign = self.count[look]
            key = np.where(sign > 0, self.keys[look], -self.keys[look])
            check = np.where(sign > 0, self.checks[look], -self.checks[look])
            pure = _check(key) == check
            row, key, sign = look[pure] // self.width, key[pure], sign[pure]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[once], key[once], sign[once]
            if not len(row):
                break
            found.append((row, key, sign))
            self.add(row, key, -sign)
            touched = np.unique(np.concatenate([row * self.width + _cells(key, third, self.t) for third in range(THIRDS)]))
            look = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(-1, self.width).any(axis=1)
        if not found:
            return done, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return done, *(np.concatenate(part) for part in zip(*found))


def encode(texts: list[str], row: np.ndarray, keys: np.ndarray) -> list[str]:
    """The fingerprint of each text: number of pieces, XXH64 of the text and the cells of the
    smallest sketch, in base64."""
    base = Sketches(len(texts), BASE)
    base.add(row, keys)
    cells = np.zeros(len(base.count), np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")]))
    cells["count"], cells["keys"], cells["checks"] = base.count, base.keys, base.checks
    raw, size = cells.tobytes(), cells.itemsize * base.width
    n = np.bincount(row, minlength=len(texts))
    return [base64.b64encode(struct.pack("<IQ", n[i], xxhash.xxh64_intdigest(t.encode())) + raw[i * size:(i + 1) * size]).decode()
            for i, t in enumerate(texts)]


def differences(row: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, sign, cells): the digests that the pairs of sets (a[i], b[i]) do not share, +1
    if a has them and -1 if b has; and the sketch size that gave them, for each pair."""
    first = np.searchsorted(row, np.arange(int(max(a.max(initial=0), b.max(initial=0))) + 2))
    open_, t, cells, out = np.arange(len(a)), BASE, np.zeros(len(a), np.int64), []
    while len(open_):
        sets, at = np.unique(np.concatenate([a[open_], b[open_]]), return_inverse=True)
        sizes = first[sets + 1] - first[sets]
        take = np.repeat(first[sets] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        made = Sketches(len(sets), t)
        made.add(np.repeat(np.arange(len(sets)), sizes), keys[take])
        done, pair, key, sign = made.minus(at[:len(open_)], at[len(open_):]).peel()
        good = done[pair]
        out.append((open_[pair[good]], key[good], sign[good]))
        cells[open_[done]] = THIRDS * t
        open_, t = open_[~done], 2 * t
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), cells
    return *(np.concatenate(part) for part in zip(*out)), cells


def likeness(row: np.ndarray, n_sets: int, a: np.ndarray, b: np.ndarray, pair: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Common digests over all digests of each pair; 1 where neither has any."""
    size = np.bincount(row, minlength=n_sets)
    only_a = np.bincount(pair[sign > 0], minlength=len(a))
    only_b = np.bincount(pair[sign < 0], minlength=len(a))
    common = size[a] - only_a
    total = common + only_a + only_b
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


# --- version pairs -------------------------------------------------------------------------

COMPARED = "fingerprint string, new_fingerprint string, likeness double, cells long, only_old array<string>, only_new array<string>"


def _chunks(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    """Consecutive rows with about ``SLICE_BYTES`` of text together."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= SLICE_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def compare(versions: DataFrame, keep: list[str], old: str, new: str) -> DataFrame:
    """The columns ``keep``, both fingerprints, likeness, the number of cells that peeling
    took, and the digests that only the old or only the new text has (16 hex digits)."""
    df = versions.select(*keep, F.coalesce(old, F.lit("")).alias("_old"), F.coalesce(new, F.lit("")).alias("_new"))
    kept = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), COMPARED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            pairs = zip(whole.column("_old").to_pylist(), whole.column("_new").to_pylist())
            at = 0
            for chunk in _chunks(pairs, lambda r: len(r[0]) + len(r[1])):
                n, texts = len(chunk), [t for t, _ in chunk] + [t for _, t in chunk]
                row, keys = piece_keys(texts)
                a = np.arange(n)
                pair, key, sign, cells = differences(row, keys, a, a + n)
                marks = encode(texts, row, keys)
                only = {1: [[] for _ in range(n)], -1: [[] for _ in range(n)]}
                for p, k, s in sorted(zip(pair.tolist(), key.tolist(), sign.tolist())):
                    only[s][p].append(f"{k:016x}")
                cols = [whole.column(f.name).slice(at, n) for f in kept]
                cols += [pa.array(marks[:n]), pa.array(marks[n:]), pa.array(likeness(row, 2 * n, a, a + n, pair, sign)), pa.array(cells),
                         pa.array(only[1], pa.list_(pa.string())), pa.array(only[-1], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), "fingerprint", "new_fingerprint", "likeness", "cells", "only_old", "only_new"])
                at += n

    return df.mapInArrow(run, schema)


# --- documents and their successors --------------------------------------------------------

SUCCEEDED = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
             "cells long, copies long")


def _key(doc_id, h) -> tuple:
    return (0, 0, h) if doc_id is None else (1, doc_id, h)


def _ranges(docs: DataFrame) -> list[tuple]:
    """The smallest (doc_id, text hash) of each range of documents."""
    spark = docs.sparkSession
    keys = materialize(docs.select("doc_id", "_h"))
    n = max(default_parallelism(spark), keys.count() // RANGE_ROWS)
    parts = keys.repartitionByRange(n, "doc_id", "_h").groupBy(F.spark_partition_id().alias("p")).agg(
        F.min(F.struct("doc_id", "_h")).alias("k"))
    return sorted(_key(r.k["doc_id"], r.k["_h"]) for r in parts.collect())


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def succeed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, the digest and fingerprint of its edited text
    (its second half replaced by the beginning of the document after it), its own fingerprint, and
    how like it the edited text and the document after it are."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cuts = _ranges(docs)
    if not cuts:
        return docs.sparkSession.createDataFrame([], f"doc_id {id_type}, {SUCCEEDED}").drop("copies")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, texts = b.column("doc_id").to_pylist(), b.column("_h").to_pylist(), b.column("text")
            seen: dict[tuple, list[int]] = {}
            take, part, guest, copies = [], [], [], []
            for i, k in enumerate(map(_key, ids, hashes)):
                same = seen.setdefault(k, [])
                at = next((j for j in same if texts[take[j]] == texts[i]), None)
                if at is not None:
                    copies[at] += 1
                    continue
                p = bisect.bisect_right(cuts, k) - 1
                same.append(len(take))
                take.append(i), part.append(p), guest.append(0), copies.append(1)
                if cuts[p] == k:            # the first of its range ends the range before
                    take.append(i), part.append((p - 1) % len(cuts)), guest.append(1), copies.append(0)
            kept = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(guest, pa.int32()), pa.array(copies, pa.int64()), *kept.columns],
                                             ["part", "guest", "copies", *kept.schema.names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, copies) with equal rows added up; copies 0 marks a guest."""
        last = None
        for b in batches:
            for i, text, guest, copies in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "guest", "copies"))):
                if last is not None and not guest and last[2] and (i, text) == last[:2]:
                    last = (i, text, last[2] + copies)
                    continue
                if last is not None and last[2]:
                    yield last
                if not (guest and last is not None and not last[2]):
                    last = (i, text, copies)
        if last is not None:
            yield last

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for chunk in _chunks(stream(batches), lambda r: len(r[1])):
            if carry is not None:
                chunk.insert(0, carry)
            carry = chunk[-1]
            if len(chunk) > 1:
                yield told(chunk)

    def told(chunk: list[tuple]) -> pa.RecordBatch:
        """Results of all rows of the chunk but the last, which only follows; the copies of a row
        are followed by each other."""
        texts = [t for _, t, _ in chunk]
        steps = [(i, i + 1, 1) for i in range(len(chunk) - 1)] + [(i, i, c - 1) for i, (_, _, c) in enumerate(chunk[:-1]) if c > 1]
        n, m = len(texts), len(steps)
        edited = [_edited(texts[i], texts[j]) for i, j, _ in steps]
        row, keys = piece_keys(texts + edited)
        here, following = np.array([i for i, _, _ in steps]), np.array([j for _, j, _ in steps])
        a, b = np.concatenate([here, here]), np.concatenate([n + np.arange(m), following])
        pair, _, sign, cells = differences(row, keys, a, b)
        near = likeness(row, n + m, a, b, pair, sign)
        marks = encode(texts + edited, row, keys)
        cols = [pa.array([chunk[i][0] for i in here], pa_id), pa.array([len(texts[i]) for i in here], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([marks[i] for i in here]), pa.array(marks[n:]),
                pa.array(near[:m]), pa.array(near[m:]), pa.array(np.maximum(cells[:m], cells[m:])), pa.array([c for _, _, c in steps], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f.split()[0] for f in SUCCEEDED.split(", "))])

    pa_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    dealt = docs.mapInArrow(deal, f"part int, guest int, copies long, doc_id {id_type}, text string, _h long")
    ranged = dealt.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("guest", "doc_id", "_h", "text")
    made = ranged.mapInArrow(finish, f"doc_id {id_type}, {SUCCEEDED}")
    again = made.withColumn("_b", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)")))
    return again.withColumn("_c", F.explode(F.expr("sequence(1L, least(4096, copies - _b * 4096))"))).drop("_b", "_c", "copies")
