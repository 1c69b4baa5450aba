"""Benchmark decontamination by template canonicalisation.

Texts become sequences of word templates: numbers, names and units are replaced by
typed placeholders, every other word is its lower-case form.  Windows of ``WINDOW``
template words are hashed; the windows of all documents are hash-joined with the
windows of the benchmark.  Hits of one item on one diagonal (document position minus item
position) without a gap form a run.  For each run the slots are checked: a value that fills
several slots of the item must be replaced by one value everywhere; two values may get
the same one.  Inconsistent runs are dropped, other runs of their diagonal stay; consistent ones are ``exact`` (all slots
as in the item) or ``reparameterised``.

A document leaks an item if consistent runs cover ``COVERAGE`` of the item's words, or
``WORDS`` words in one run.  Windows with placeholders need ``LITERAL`` ordinary words, so rows of
numbers do not match each other; every window is hashed by its actual words as well,
which need no ordinary word to match; items shorter than a window are one window of their own length.

The benchmark's windows go to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass
over the documents per block; a block is a broadcast of bounded size.  Documents are not
shuffled.

Edge cases: null and empty texts match nothing, nor do items without words; an
item's exact copies (repeated rows) are one item; items of one id with different
texts are reported one by one; a passage that repeats
inside a document counts once; repeated documents give repeated results; rows with a
null doc_id or item_id take part under that id; empty tables give no rows; further
columns are ignored by :func:`leaks` and kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_class, gram_hashes, slices, utf8, within_rows, word_hashes, word_spans

WINDOW = 8
LITERAL = 4
COVERAGE = 0.5
WORDS = 13
BLOCK_WORDS = 1 << 20

NUMBER, NAME, UNIT = 1, 2, 3
#: fixed values: words that stand for a unit or for a number
UNITS = """
kg g mg lb lbs oz ton tons km m cm mm mile miles ft feet foot inch inches yard yards
l ml litre litres liter liters gallon gallons hour hours minute minutes second seconds day days week weeks month months year years
dollar dollars euro euros pound pounds cent cents usd eur gbp percent degree degrees mph kmh watt watts volt volts
""".split()
NUMBERS = """
one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand million
""".split()

_DIGIT = byte_class((0x30, 0x39))
_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = byte_class((0x41, 0x5A))
_SENTENCE_END = byte_class(*((ord(c), ord(c)) for c in ".!?:\n\r\""))


def _of(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words))
    starts, ends, _ = word_spans(data, offsets, _WORD)
    return np.sort(word_hashes(data, starts, ends))


class Templates:
    """Template words of the rows of a column: ``kind`` (0: ordinary word),
    ``value`` (hash of the lower-case word), ``plain`` and ``named`` (template hashes
    without and with name placeholders), ``first`` (row bounds)."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        shown, offsets = utf8(column)
        data, low_offsets = utf8(pc.utf8_lower(column))
        if not np.array_equal(offsets, low_offsets):  # a few capitals change their length
            same = pa.array([t if len(t.lower().encode()) != len(t.encode()) else t.lower() for t in column.to_pylist()], pa.string())
            data, low_offsets = utf8(same)
        inside = _WORD[data]
        if len(data) > 2:  # a point or comma between digits belongs to the number
            mid = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
            inside[1:-1] |= mid
        starts, ends, self.first = word_spans(data, offsets, inside)
        self.value = word_hashes(data, starts, ends)
        kind = np.zeros(len(starts), np.int8)
        if len(starts):
            stops = np.concatenate(([0], np.cumsum(_SENTENCE_END[data])))
            before = np.concatenate(([0], ends[:-1]))
            opens = stops[starts] > stops[before]
            opens[self.first[:-1][np.diff(self.first) > 0]] = True
            after = data[np.minimum(starts + 1, len(data) - 1)]
            low_next = (ends - starts > 1) & (shown[np.minimum(starts + 1, len(data) - 1)] == after)
            kind[_UPPER[shown[starts]] & low_next & ~opens] = NAME
            kind[np.isin(self.value, _UNITS)] = UNIT
            kind[_DIGIT[data[starts]] | np.isin(self.value, _NUMBERS)] = NUMBER
        self.kind = kind
        mark = np.array([0, 0x51ED270B, 0x6C8E9CF5, 0x2545F491], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = (kind == NUMBER) | (kind == UNIT)
        self.plain = np.where(slot, mark[kind], self.value)
        self.named = np.where(kind > 0, mark[kind], self.value)

    def windows(self, k: int, named: bool | None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of windows with enough ordinary words; None: of all windows,
        by their actual words."""
        ok = within_rows(self.first, k)
        n = len(ok)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if named is None:
            return gram_hashes(self.value, k)[ok], np.flatnonzero(ok)
        slot = self.kind > 0 if named else (self.kind == NUMBER) | (self.kind == UNIT)
        literal = np.concatenate(([0], np.cumsum(~slot)))
        ok &= literal[k:k + n] - literal[:n] >= min(LITERAL, k)
        at = np.flatnonzero(ok)
        return gram_hashes(self.named if named else self.plain, k)[at], at


_UNITS, _NUMBERS = _of(UNITS), _of(NUMBERS)


class Index:
    """Sorted windows of a block of benchmark items."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.t = t = Templates(pa.array([x for _, x in items], pa.string()))
        size = np.diff(t.first)
        row = np.repeat(np.arange(len(items)), size)
        self.tables = {}  # window length -> sorted hashes and first words
        for k in sorted({min(WINDOW, int(n)) for n in size if n}):
            hashes, at = [], []
            for named in (False, True, None):
                h, a = t.windows(k, named)
                fit = np.minimum(size[row[a]], WINDOW) == k
                hashes.append(h[fit])
                at.append(a[fit])
            h, a = np.concatenate(hashes), np.concatenate(at)
            pair = np.unique(np.stack([h, a.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
            self.tables[k] = (pair[0], pair[1].astype(np.int64))
        self.row, self.size = row, size

    def hits(self, docs: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document word, item word, window length) of all equal windows."""
        out = [(np.zeros(0, np.int64),) * 3]
        for k, (known, at) in self.tables.items():
            if not len(known):
                continue
            for named in (False, True, None):
                h, a = docs.windows(k, named)
                lo = np.searchsorted(known, h)
                found = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
                lo, a = lo[found], a[found]
                hi = np.searchsorted(known, h[found], "right")
                n = hi - lo
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(a, n), at[np.repeat(lo, n) + inner], np.full(int(n.sum()), k)))
        return tuple(np.concatenate(x) for x in zip(*out))


def _consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """A slot value is replaced by one value everywhere."""
    pairs = np.unique(np.stack([item, doc]), axis=1)
    return len(np.unique(pairs[0])) == pairs.shape[1]


def _runs(docs: Templates, index: Index) -> Iterator[tuple]:
    """(row, item, start, words covered, coverage, exact) for each leaked item of a row."""
    d, i, k = index.hits(docs)
    if not len(d):
        return
    row = np.searchsorted(docs.first, d, "right") - 1
    item = index.row[i]
    diagonal = (d - docs.first[row]) - (i - index.t.first[item])
    order = np.lexsort((d, diagonal, item, row))
    d, i, k, row, item, diagonal = (x[order] for x in (d, i, k, row, item, diagonal))
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])))
    starts = np.append(np.flatnonzero(new), len(d))
    best: dict[tuple[int, int], list] = {}
    for a, b in zip(starts[:-1], starts[1:]):
        words = np.unique((i[a:b, None] + np.arange(int(k[a:b].max()))[None, :])[np.arange(int(k[a:b].max()))[None, :] < k[a:b, None]])
        for run in np.split(words, np.flatnonzero(np.diff(words) > 1) + 1):
            there = run + (d[a] - i[a])
            slot = (index.t.kind[run] > 0) | (docs.kind[there] > 0)
            mine, theirs = index.t.value[run[slot]], docs.value[there[slot]]
            if len(mine) and not _consistent(mine, theirs):
                continue
            start = int(there[0] - docs.first[row[a]])
            known = best.setdefault((int(row[a]), int(item[a])), [start, set(), 0, True])
            known[0] = min(known[0], start)
            known[1].update(run.tolist())
            known[2] = max(known[2], len(run))
            known[3] &= bool((mine == theirs).all())
    for (r, it), (start, words, longest, exact) in best.items():
        n = int(index.size[it])
        if len(words) >= COVERAGE * n or longest >= WORDS:
            yield r, it, start, len(words), len(words) / n, exact


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of bounded size.  Items come to the driver one
    partition at a time and leave it as one bounded broadcast per pass; the driver
    holds one block."""
    now, words = [], 0
    for r in benchmark.select("item_id", "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").split())
        if now and words + n > BLOCK_WORDS:
            yield now
            now, words = [], 0
        now.append((r["item_id"], r["text"]))
        words += n
    if now:
        yield now


LEAKS = "start_word long, words long, coverage double, kind string"


def _search(index, keep: list[str], id_type: pa.DataType):
    names = [*keep, "item_id", "start_word", "words", "coverage", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(index.value)
        for batch in batches:
            for part in slices(batch):
                found = list(_runs(Templates(part.column("text")), known))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in keep),
                     pa.array([known.ids[f[1]] for f in found], id_type), pa.array([f[2] for f in found], pa.int64()),
                     pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.float64()),
                     pa.array(["exact" if f[5] else "reparameterised" for f in found], pa.string())], names)
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document row and leaked item: the columns ``keep``, item_id (of any type),
    start_word, words and coverage (of the item), kind."""
    spark = docs.sparkSession
    item = benchmark.schema["item_id"].dataType
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"item_id {item.simpleString()}", LEAKS])
    out = None
    for block in _blocks(benchmark):
        found = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
            _search(spark.sparkContext.broadcast(block), keep, to_arrow_type(item)), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; no row is shuffled."""
    spark = docs.sparkSession
    for block in _blocks(benchmark):
        box = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            known = Index(box.value)
            for batch in batches:
                for part in slices(batch):
                    stays = np.ones(part.num_rows, bool)
                    stays[[f[0] for f in _runs(Templates(part.column("text")), known)]] = False
                    yield part.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
