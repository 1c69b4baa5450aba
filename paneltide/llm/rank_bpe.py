"""BPE encoding and decoding with a contiguous rank array.

A short word is one row of part ids (its part boundaries) and one contiguous row
of the ranks of adjacent pairs.  The smallest rank is searched by a scan, its
boundary is deleted, and the two neighbouring ranks are refreshed; all distinct
new words of a text slice go through this together, one merge each per round.
Words above ``SHORT`` bytes keep the same order of merges with a heap, so one run
of 100,000 letters costs n log n.  Words repeat often; each Python worker
remembers about ``CACHE`` of them.

Text rules are those of the vocabulary file (read from its own fields): NFC,
white space runs to one space, lower case, the split pattern, byte letters and
a word-end suffix; strings of special tokens in a text become those tokens.

Edge cases: null text is the empty text, and an empty text has no ids and decodes
to the empty string; very long words use the heap; repeated rows give repeated
results; an empty table gives no rows; columns of the input are kept as they are
(``ids`` and ``decoded`` are replaced if the input already has them).
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SHORT = 96
GROUP = 2048
CACHE = 200_000
_NONE = np.int32(2**31 - 1)
_TABLE_BITS, _TABLE_MASK, _SCATTER = 18, np.int64((1 << 18) - 1), np.int64(0x1E3779B97F4A7C15)
_SPACE = r"\p{White_Space}"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class RankBpe:
    """One vocabulary: text -> ids -> text."""

    def __init__(self, payload: str):
        spec = json.loads(payload)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.special = special
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.slot_key, self.slot_rank = np.full(1 << _TABLE_BITS, -1, np.int64), np.full(1 << _TABLE_BITS, _NONE, np.int32)
        for key, r in self.rank.items():
            at = int((np.array([key]) * _SCATTER >> np.int64(64 - _TABLE_BITS))[0]) & int(_TABLE_MASK)
            while self.slot_key[at] != -1:
                at = (at + 1) & int(_TABLE_MASK)
            self.slot_key[at], self.slot_rank[at] = key, r
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACE)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent ids; ``_NONE`` where there is none."""
        key = (a.astype(np.int64) << 20) | b
        at = (key * _SCATTER) >> np.int64(64 - _TABLE_BITS) & _TABLE_MASK
        out = np.where(self.slot_key[at] == key, self.slot_rank[at], _NONE)
        again = np.flatnonzero((self.slot_key[at] != key) & (self.slot_key[at] != -1))
        while len(again):
            at[again] = (at[again] + 1) & _TABLE_MASK
            found = self.slot_key[at[again]]
            hit = found == key[again]
            out[again[hit]] = self.slot_rank[at[again[hit]]]
            again = again[~hit & (found != -1)]
        return out

    def _merge_group(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of short words of like length.  Row w of ``ranks`` is the rank
        array of word w; each round scans every row for its minimum, deletes that
        boundary and refreshes the ranks on both sides."""
        n, lens = len(words), np.array([len(w) for w in words])
        width = int(lens.max()) + 1  # the last column stays empty
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lens) - lens
        cell = np.arange(len(data)) + np.repeat(np.arange(n) * width - starts, lens)
        parts = np.full(n * width, -1, np.int32)
        parts[cell] = self.inner_ids[data]
        parts[cell[starts + lens - 1]] = self.last_ids[data[starts + lens - 1]]
        ranks = np.full(n * width, _NONE, np.int32)
        ranks[:-1] = self._lookup(parts[:-1], parts[1:])
        after = np.arange(1, n * width + 1)
        before = np.arange(-1, n * width - 1)
        rows = np.arange(n)
        while len(rows):
            live = ranks.reshape(n, width)[rows] if len(rows) < n else ranks.reshape(n, width)
            i = live.argmin(axis=1)
            low = live[np.arange(len(rows)), i]
            ok = low < _NONE
            rows, i, low = rows[ok], i[ok] + rows[ok] * width, low[ok]
            j = after[i]
            k = after[j]  # at most the word's empty last cell
            parts[i], parts[j], ranks[j] = self.merged[low], -1, _NONE
            after[i], before[k] = k, i
            ranks[i] = self._lookup(parts[i], parts[k])
            p = np.maximum(before[i], 0)
            left = self._lookup(parts[p], parts[i])
            inside = before[i] >= rows * width
            ranks[p[inside]] = left[inside]
        kept = parts >= 0
        ids = parts[kept].tolist()
        ends = np.cumsum(kept.reshape(n, width).sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merge_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word, short words in groups of like length."""
        coded = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        out: dict[str, tuple[int, ...]] = {}
        short = [x for x in coded if len(x[0]) <= SHORT]
        for at in range(0, len(short), GROUP):
            group = short[at:at + GROUP]
            out.update(zip([w for _, w in group], self._merge_group([b for b, _ in group])))
        for b, w in coded[len(short):]:
            out[w] = tuple(self._merge_long([*(self.inner[x] for x in b[:-1]), self.last[b[-1]]]))
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two parts has merged meanwhile
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; all distinct words that the cache lacks are merged together."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        cache, plan = self.cache, []
        for text in texts:
            for piece in self.cut(text) if self.cut and "<|" in text else (text,):
                # lower case is by character: a final sigma keeps its common form
                plan.append([piece] if piece in self.special else
                            self.words(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()))
            plan.append(None)
        new = set().union(*filter(None, plan)).difference(cache, self.special)
        cache.update(self.merge_words(list(new)))
        out, row = [], []
        for words in plan:
            if words is None:
                out.append(row)
                row = []
            elif len(words) == 1 and words[0] in self.special:
                row.append(self.special[words[0]])
            else:
                row.extend(itertools.chain.from_iterable(map(cache.__getitem__, words)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded`` string (read back from ids).

    The vocabulary file (a fixed file of a few MB, at a path that the driver
    reads) goes to the executors in a broadcast variable."""
    spark = docs.sparkSession
    with open(vocab_path, encoding="utf-8") as f:
        payload = spark.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RankBpe(payload.value)
        for batch in batches:
            for part in slices(batch, text):
                ids = bpe.encode_many([t or "" for t in part.column(text).to_pylist()])
                cols = [part.column(c) for c in kept]
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(run, schema)


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 of the columns ids and decoded."""
    as_text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(as_text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
