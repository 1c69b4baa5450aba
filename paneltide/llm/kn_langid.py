"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 per language, over lower-cased letters with every run of
other characters as one blank.  N-gram counts come from all labelled documents
outside the held-out fold, pre-aggregated in the tasks; continuation counts, discounts,
back-off weights and probabilities of all orders are Spark tables made from all n-grams.  A
model is a set of sorted arrays (n-gram key -> log probability, context key -> back-off
weight) read with binary search; a key packs four 16-bit characters.  The language of lowest
cross-entropy per character wins.

Models go to the tasks in groups of languages, each group of at most ``GROUP_BYTES`` (counted
before it is fetched; a language is never split).  With several groups the rows pass through
one group after another, carrying their best language so far and each word's best log
probability; the result is the same.

Rejection is calibrated, on the cross-entropy with the best language of each word
(a document that quotes another known language is not foreign): models of the labelled folds other than
``CALIBRATION`` tell how far a document of that fold strays from
its language's mean.  They also judge the documents of that fold; the models for all others
have learnt from it as well.  The deviation is standardised by the document's length, and a
document is rejected beyond ``SLACK`` times the deviation that a share of ``FALSE_REJECT`` of
its language's calibration documents exceed (of all, where the language has too few), and only if it is at least as far off as a text of ``LONG`` characters with ``FAR`` nats per character
more than its language's mean, so that few calibration documents don't make it strict.

Edge cases: null text or text without a letter is ``und`` with score 0 and is
rejected; very long texts are scored whole; equal cross-entropies go to the
alphabetically first language; repeated rows count as often as they stand; without
labelled rows, or on an empty table, there is no model: every row is ``und`` with
score 0 and only texts without a letter are rejected; :func:`keep_known` keeps further
columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.session import materialize

from .common import sheltered, slices

FOLDS, CALIBRATION = 5, 1
#: bytes of model tables that a task holds at once, unless one language alone has more
GROUP_BYTES = 128 << 20
SLACK = 1.25
#: share of a language's calibration documents that may lie beyond its quantile
FALSE_REJECT = 0.01
FAR, LONG = 1.0, 400
#: distinct n-grams a task holds before it passes their counts on
HELD = 1 << 19
#: characters that count towards the certainty of a prediction
SURE_CHARS = 40
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all 4-grams, row of each, letters per row, place of each word's first gram).  Three pad symbols stand
    between rows, so a gram depends on its own row alone."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\0\0\0" + "\0\0\0".join(low) + "\0\0\0").encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in low], np.int64)
    start = np.cumsum(size + 3) - size
    row = np.repeat(np.arange(len(low)), size + 3)  # a row's body and the pads after it
    row = np.concatenate((np.zeros(3, np.int64), row))
    pad = np.ones(len(code), bool)
    pad[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = False
    letter = _letters()[code]
    symbol = np.where(letter, np.where(code < 0x10000, code, 0xD800 | code & 0x7FF), 32).astype(np.uint64)
    symbol[pad] = 0
    keep = np.ones(len(code), bool)
    keep[1:] = (symbol[1:] != 32) | (symbol[:-1] != 32)
    found = np.bincount(row[letter & ~pad], minlength=len(low))
    symbol, row = symbol[keep], row[keep]
    s16, s32, s48 = np.uint64(16), np.uint64(32), np.uint64(48)
    key = symbol[:-3] << s48 | symbol[1:-2] << s32 | symbol[2:-1] << s16 | symbol[3:]
    ends = (symbol[3:] != 0) | (symbol[2:-1] != 0)  # a character, or the first pad after the last one
    head = np.concatenate(([True], (symbol[3:-1] == 32) | (row[3:-1] != row[4:])))[ends[:len(key)]] if len(key) else ends
    return key[ends], row[3:][ends], found, np.flatnonzero(head)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, pd.Series] = {}

    def flush():
        for (lang, later), s in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(s)), pa.array([later] * len(s)), pa.array(s.index.to_numpy().view(np.int64)), pa.array(s.to_numpy(np.int64))],
                ["lang", "later", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch):
            langs = list(zip(part.column("lang").to_pylist(), part.column("later").to_pylist()))
            texts = part.column("text").to_pylist()
            for lang in set(langs):
                key, _, _, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                code, distinct = pd.factorize(key)
                now = pd.Series(np.bincount(code, minlength=len(distinct)), index=distinct)
                held[lang] = held[lang].add(now, fill_value=0) if lang in held else now
            if sum(map(len, held.values())) > HELD:
                yield from flush()
    yield from flush()


def _discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


class KneserNey:
    """One language: sorted key arrays of orders 4 to 1 with interpolated log
    probabilities and back-off weights."""

    def __init__(self, key: np.ndarray, count: np.ndarray, n1: float, n2: float):
        at = np.argsort(key)
        keys, counts = [key[at]], [count[at].astype(float)]
        for bits in (48, 32, 16):  # how many different characters stand before the shorter n-gram
            k, c = np.unique(keys[-1] & np.uint64(2**bits - 1), return_counts=True)
            keys.append(k)
            counts.append(c.astype(float))
        d = [_discount(n1, n2), *(_discount((c == 1).sum(), (c == 2).sum()) for c in counts[1:])]
        self.floor = np.log(d[3] / counts[3].sum())
        p = np.maximum(counts[3] - d[3], 0) / counts[3].sum() + d[3] / counts[3].sum()
        self.orders = [(keys[3], np.log(p), None, None)]
        for k, c, disc in zip(keys[2::-1], counts[2::-1], d[2::-1]):
            ctx, where = np.unique(k >> np.uint64(16), return_inverse=True)
            total = np.bincount(where, c)
            weight = disc * np.bincount(where) / total
            bits = 16 * len(self.orders)
            lower = np.exp(self.log_prob(k & np.uint64(2**bits - 1)))
            p = np.maximum(c - disc, 0) / total[where] + weight[where] * lower
            self.orders.append((k, np.log(p), ctx, np.log(weight)))

    @classmethod
    def of_tables(cls, floor: float, logp: list[tuple], weights: list[tuple]) -> KneserNey:
        """From (keys, log probabilities) of orders 1 to 4 and (contexts, log weights) of 2 to 4."""
        made = cls.__new__(cls)
        made.floor, made.orders = floor, []
        for (k, p), (ctx, w) in zip(logp, [(None, None), *weights]):
            at, by = np.argsort(k), None if ctx is None else np.argsort(ctx)
            made.orders.append((k[at], p[at], None if by is None else ctx[by], None if by is None else w[by]))
        return made

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each key, by the orders built so far."""
        out = np.full(len(key), self.floor)
        for n, (known, logp, ctx, weight) in enumerate(self.orders, 1):
            k = key & np.uint64(2**(16 * n) - 1)
            if ctx is not None:
                c = k >> np.uint64(16)
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                out = out + np.where(ctx[at] == c, weight[at], 0.0)
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            out = np.where(known[at] == k, logp[at], out)
        return out


def counted(docs: DataFrame, later: Column) -> DataFrame:
    """lang, gram, first and both: how often a 4-gram stands in the labelled rows of ``docs``
    that are not ``later``, and in all of them."""
    rows = docs.select("text", "lang", F.coalesce(later, F.lit(False)).alias("later")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(_count, "lang string, later boolean, gram long, n long")
    return materialize(parts.groupBy("lang", "gram").agg(
        F.sum(F.when(~F.col("later"), F.col("n")).otherwise(0)).alias("first"), F.sum("n").alias("both")))


class Models:
    """The tables of all languages: ``logp`` (lang, n, key, logp) of every n-gram of order n and
    ``weight`` (lang, n, key, logw) of every context of order n, where lang begins with ``mark``;
    on the driver only the size and the floor of each language."""

    def __init__(self, logp: DataFrame, weight: DataFrame, mark: str, floors: dict[str, float], sizes: dict[str, int]):
        self.logp, self.weight, self.mark, self.floors, self.sizes = logp, weight, mark, floors, sizes

    def groups(self) -> list[list[str]]:
        """Languages in alphabetical order, as many together as ``GROUP_BYTES`` hold."""
        out: list[list[str]] = []
        room = 0
        for lang in sorted(self.sizes):
            need = 16 * self.sizes[lang]
            if not out or need > room:
                out.append([])
                room = GROUP_BYTES
            out[-1].append(lang)
            room -= need
        return out

    def fetch(self, langs: list[str]) -> dict[str, KneserNey]:
        def arrays(table: DataFrame, value: str) -> dict[tuple, tuple]:
            parts: dict[tuple, list] = {}
            rows = table.where(F.col("lang").isin(*(self.mark + x for x in langs))).select("lang", "n", "key", F.col(value).alias("v"))
            for r in rows.mapInArrow(_packed, "lang string, n int, keys binary, values binary").collect():    # as bytes, 16 an entry
                parts.setdefault((r.lang[1:], r.n), []).append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"], float)))
            return {k: tuple(map(np.concatenate, zip(*p))) for k, p in parts.items()}

        logp, weight = arrays(self.logp, "logp"), arrays(self.weight, "logw")
        return {x: KneserNey.of_tables(self.floors[x], [logp[x, n] for n in (1, 2, 3, 4)], [weight[x, n] for n in (2, 3, 4)]) for x in langs}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys and values of each language and order of a batch as two binary values."""
    for b in batches:
        lang, n = b.column("lang").dictionary_encode(), b.column("n").to_numpy()
        key, value, code = b.column("key").to_numpy(), b.column("v").to_numpy(), lang.indices.to_numpy()
        out = []
        for c, name in enumerate(lang.dictionary.to_pylist()):
            for order in np.unique(n[code == c]).tolist():
                at = (code == c) & (n == order)
                out.append((name, order, key[at].tobytes(), value[at].tobytes()))
        cols = list(zip(*out)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "n", "keys", "values"])


def train(counts: DataFrame, n: str) -> Models | None:
    """The models of all languages from the counts in column ``n``."""
    return train_all(counts, [n])[n]


def train_all(counts: DataFrame, names: list[str]) -> dict[str, Models | None]:
    """Models from each of the count columns ``names`` (zeros left out), made in the same jobs."""
    spark = counts.sparkSession
    marks = {n: str(i) for i, n in enumerate(names)}
    tables = {4: reduce(DataFrame.unionByName, [counts.where(F.col(n) > 0).select(
        F.concat(F.lit(m), "lang").alias("lang"), F.col("gram").alias("key"), F.col(n).cast("double").alias("c")) for n, m in marks.items()])}
    for order in (3, 2, 1):  # how many different characters stand before the shorter n-gram
        tables[order] = materialize(tables[order + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(2 ** (16 * order) - 1)).alias("key"))
                                    .agg(F.count("*").cast("double").alias("c")))
    seen: dict[tuple, tuple] = {}
    for order, t in tables.items():
        for r in t.groupBy("lang").agg(F.count("*").alias("size"), F.sum("c").alias("total"),
                                       F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect():
            seen[r["lang"], order] = (_discount(r["n1"], r["n2"]), r["total"], r["size"])
    langs = sorted({lang for lang, _ in seen})
    if not langs:
        return dict.fromkeys(names)
    facts = spark.createDataFrame([(lang, order, d, total) for (lang, order), (d, total, _) in seen.items()], "lang string, n int, d double, total double")
    above = F.greatest(F.col("c") - F.col("d"), F.lit(0.0))
    p = materialize(tables[1].join(facts.where("n = 1").drop("n"), "lang").select("lang", "key", ((above + F.col("d")) / F.col("total")).alias("p")))
    logp, weights = [p.select("lang", F.lit(1).alias("n"), "key", F.log("p").alias("logp"))], []
    for order in (2, 3, 4):
        t = tables[order].withColumn("ctx", F.shiftrightunsigned("key", 16)).join(facts.where(F.col("n") == order).select("lang", "d"), "lang")
        ctx = materialize(t.groupBy("lang", "ctx", "d").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
                          .select("lang", "ctx", "total", (F.col("d") * F.col("types") / F.col("total")).alias("w")))
        weights.append(ctx.select("lang", F.lit(order).alias("n"), F.col("ctx").alias("key"), F.log("w").alias("logw")))
        lower = p.select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower"))
        t = t.withColumn("suffix", F.col("key").bitwiseAND(F.lit(2 ** (16 * (order - 1)) - 1)))
        # these tables grow with the corpus: merged, so that none passes through the driver
        p = materialize(t.join(ctx.hint("merge"), ["lang", "ctx"]).join(lower.hint("merge"), ["lang", "suffix"])
                        .select("lang", "key", (above / F.col("total") + F.col("w") * F.col("lower")).alias("p")))
        logp.append(p.select("lang", F.lit(order).alias("n"), "key", F.log("p").alias("logp")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    every, contexts, out = union(logp), union(weights), {}
    for n, m in marks.items():
        own = [x for x in langs if x.startswith(m)]
        floors = {x[1:]: float(np.log(seen[x, 1][0] / seen[x, 1][1])) for x in own}
        out[n] = Models(every, contexts, m, floors, {x[1:]: sum(seen[x, order][2] for order in tables) * 2 for x in own}) if own else None
    return out


class State:
    """What is known of the rows of a slice after some languages."""

    def __init__(self, texts: list[str | None], low=None, best=None, odds=None, words=None):
        self.key, self.row, self.letters, self.head = grams(texts)
        self.code, self.distinct = pd.factorize(self.key)
        self.n = np.bincount(self.row, minlength=len(texts))
        fresh = low is None
        self.low = np.full(len(texts), np.inf) if fresh else low                      # lowest cross-entropy
        self.best = np.full(len(texts), None, object) if fresh else best              # its language
        self.odds = np.zeros(len(texts)) if fresh else odds                           # sum of exp((low - entropy) * characters)
        self.words = np.full(len(self.head), -np.inf) if fresh else words             # best log probability of each word

    def meet(self, models: dict[str, KneserNey]) -> None:
        if not len(self.key):
            return
        word_row, sure = self.row[self.head], np.minimum(self.n, SURE_CHARS)
        for lang, m in models.items():
            word = np.add.reduceat(m.log_prob(self.distinct)[self.code], self.head)
            self.words = np.maximum(self.words, word)
            ce = -np.bincount(word_row, word, minlength=len(self.n)) / np.maximum(self.n, 1)
            low = np.minimum(self.low, ce)
            before = np.where(np.isfinite(self.low), np.exp((low - np.where(np.isfinite(self.low), self.low, 0)) * sure), 0.0)
            self.odds = self.odds * before + np.exp((low - ce) * sure)
            self.best[ce < self.low] = lang
            self.low = low

    def mixed(self) -> np.ndarray:
        """Cross-entropy with the best language of each word."""
        if not len(self.key) or not np.isfinite(self.words).all():
            return np.zeros(len(self.n))
        return -np.bincount(self.row[self.head], self.words, minlength=len(self.n)) / np.maximum(self.n, 1)


SCORED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("entropy", T.DoubleType()), T.StructField("chars", T.LongType()), T.StructField("letters", T.LongType())])


CARRIED = T.StructType([T.StructField("_low", T.DoubleType()), T.StructField("_best", T.StringType()), T.StructField("_odds", T.DoubleType()),
                        T.StructField("_words", T.ArrayType(T.DoubleType()))])


def scored(docs: DataFrame, models: Models | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, entropy (per character,
    with the best language of each word), chars, letters."""
    names = [f.name for f in SCORED]
    keep = [c for c in keep if c not in names]
    need = list(dict.fromkeys([*keep, "text"]))
    rows, groups = docs.select(*need), models.groups() if models else [[]]
    for i, group in enumerate(groups):
        box = docs.sparkSession.sparkContext.broadcast(models.fetch(group) if models else {})
        schema = T.StructType([rows.schema[c] for c in keep] + SCORED.fields)
        if i < len(groups) - 1:
            schema = T.StructType([rows.schema[c] for c in need] + CARRIED.fields)
        rows = rows.mapInArrow(_meeting(box, keep if i == len(groups) - 1 else need, i > 0, i == len(groups) - 1), schema)
        if i < len(groups) - 1:
            rows = materialize(rows)
    return rows


def _meeting(box, keep: list[str], carried: bool, last: bool):
    """One group of languages meets the rows; the ``last`` one settles them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = box.value
        for batch in batches:
            for part in slices(batch):
                before = []
                if carried:
                    low, best, odds = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_low", "_best", "_odds"))
                    before = [low.astype(float), best.astype(object), odds.astype(float), part.column("_words").flatten().to_numpy(zero_copy_only=False).astype(float)]
                at = State(part.column("text").to_pylist(), *(a.copy() for a in before))
                at.meet(models)
                kept = [part.column(c) for c in keep]
                if not last:
                    ends = np.searchsorted(at.row[at.head], np.arange(len(at.n) + 1)) if len(at.key) else np.zeros(len(at.n) + 1, np.int64)
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at.words, pa.float64()))
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(at.low), pa.array(at.best, pa.string()), pa.array(at.odds), words],
                                                     [*keep, *(f.name for f in CARRIED)])
                    continue
                blank = (at.letters == 0) | np.array([b is None for b in at.best], bool)
                sure = np.divide(1.0, at.odds, out=np.zeros(len(at.n)), where=at.odds > 0)
                chars = at.n if models else at.letters
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.where(blank, UNKNOWN, at.best), pa.string()), pa.array(np.where(blank, 0.0, sure)),
                     pa.array(at.mixed()), pa.array(chars.astype(np.int64)), pa.array(at.letters.astype(np.int64))], [*keep, *(f.name for f in SCORED)])
    return run


def fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def identify(docs: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """The columns ``keep`` with held_out, lang_pred, score, rejected, entropy, chars.
    Learns from the rows of ``docs`` outside fold 0."""
    rows = docs.withColumn("_fold", F.coalesce(fold(key), F.lit(0)))
    counts = counted(rows.where("_fold <> 0"), F.col("_fold") == CALIBRATION)
    trained = train_all(counts, ["both", "first"])
    models = trained["both"]
    earlier = trained["first"] or models  # few rows: nothing is left for calibration
    known = scored(rows.where(F.col("_fold") == CALIBRATION).where("lang IS NOT NULL"), earlier, ["lang"]).where("letters > 0 AND lang = lang_pred")
    known = materialize(known.select("lang", "entropy", "chars"))
    mean = {r["lang"]: r["mean"] for r in known.groupBy("lang").agg(F.avg("entropy").alias("mean")).collect()} if models else {}

    def by_lang(lang: str, values: dict[str, float]):
        out = F.lit(None).cast("double")
        for x, v in values.items():
            out = F.when(F.col(lang) == x, F.lit(v)).otherwise(out)
        return out

    def stray(lang: str):
        return (F.col("entropy") - by_lang(lang, mean)) * F.sqrt(F.least(F.col("chars"), F.lit(LONG)).cast("double"))

    far = F.percentile_approx("stray", F.lit(1 - FALSE_REJECT), F.lit(100_000)).alias("far")
    seen = known.select("lang", stray("lang").alias("stray"))
    pooled = seen.agg(far).first()["far"] if mean else None
    limit = {}
    for r in seen.groupBy("lang").agg(far, F.count("*").alias("n")).collect() if mean else []:
        q = r["far"] if r["n"] * FALSE_REJECT >= 1 else pooled  # too few to tell that share: that of all languages
        limit[r["lang"]] = max(SLACK * q, FAR * LONG ** 0.5)
    rejected = (F.col("letters") == 0) | F.coalesce(stray("lang_pred") > by_lang("lang_pred", limit), F.lit(False))
    is_later = F.coalesce(fold(key), F.lit(0)) == CALIBRATION
    out = scored(docs.where(~is_later), models, keep).unionByName(scored(docs.where(is_later), earlier, keep))
    return out.withColumn("rejected", rejected).withColumn("held_out", F.coalesce(fold(key) == 0, F.lit(True)))


def keep_known(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that language identification rejects."""
    inner, restored = sheltered(docs, [key, "text", "lang"])
    return restored(identify(inner, inner.columns, key).where(~F.col("rejected")))
