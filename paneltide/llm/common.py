"""Helpers shared by the training-data operators: text slices of an Arrow
batch, vectorised word spans and word hashes over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of text handled at once inside a task; a longer document is one slice
SLICE_BYTES = 2 << 20

#: odd 64-bit multipliers of the polynomial hashes (all arithmetic is mod 2**64)
WORD_MULT = np.uint64(0x9E3779B97F4A7C15)
GRAM_MULT = np.uint64(0xD6E8FEB86659FD93)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about ``limit`` bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(text)
    ends = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64))
    at, base = 0, 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty.  offsets[i:i+2]
    bound row i and start at 0."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    col = pa.concat_arrays([col])  # drops the slice offset
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + col.offset)[col.offset:] if off else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A bool[256] that is true inside the given inclusive byte ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: words of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``:
#: both classes hold whole non-ASCII characters, so they can be read off bytes
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER_ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case, every other byte unchanged."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, inside) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words and, for each row, the
    index of its first word; first has one entry more than there are rows.
    ``inside`` is a bool[256] class or a bool mask over ``data``."""
    m = inside[data] if len(inside) == 256 and inside is not data else inside
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)  # a row begins at this byte
    cut[offsets] = True
    before = np.concatenate(([False], m[:-1])) & ~cut[:-1]
    after = np.concatenate((m[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _powers(mult: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), mult, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """One 64-bit hash for each word, a function of its bytes only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) * WORD_MULT)
    lens = ends - starts
    total = int(lens.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)  # place of a byte in its word
    at = inner + np.repeat(starts, lens)
    value = table[data[at]] * _powers(WORD_MULT, int(lens.max()))[inner]
    out = np.add.reduceat(value, np.cumsum(lens) - lens)
    return mix(out + lens.astype(np.uint64) * GRAM_MULT)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k consecutive words, built by doubling
    (len(words) - k + 1 values; the caller masks those that cross rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, mult = np.zeros(n, np.uint64), 0, words, int(GRAM_MULT)
    size, left, scale = 1, k, 1
    while left:
        if left & 1:
            out += power[have:have + n] * np.uint64(scale)
            have += size
            scale = scale * mult % 2**64
        left >>= 1
        if left:
            power = power[:-size] + power[size:] * np.uint64(mult)
            mult = mult * mult % 2**64
            size *= 2
    return mix(out)


def within_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over run starts 0..n_words-k: the run of k words stays in its row."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]  # the row's end for each word
    return np.arange(n) + k <= end


def sheltered(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(``docs`` with every column but the needed ones under a neutral name, a function
    that brings the names and their order back, with further columns if told), so that no
    further column of the input clashes with a working column."""
    inner = {c: c if c in needed else f"_col{i}_" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    return hidden, lambda out, more=(): out.select(*(F.col(n).alias(c) for c, n in inner.items()), *more)
