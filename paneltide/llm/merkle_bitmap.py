"""Merkle manifest of a table of documents, with leaf coordinates from bitmap ranks.

A leaf is the digest of a row; the leaves of a source ascend by doc_id.  Where a leaf
stands is not found by sorting the leaves:

1. Bitmaps.  Every source's doc_ids become 64-bit words ``(source, doc_id >> 6)``, merged
   with ``bit_or`` and partial sums; only words that hold an id exist (the compression).
2. Popcount directory.  Row counts of the words are summed into cells of ``FAN`` words,
   cells of ``FAN`` cells and so on; each level takes running sums inside one cell only,
   so no task sees more than ``FAN`` entries of a source, however many rows it has.
3. Rank.  A leaf's slot is its word's directory entry plus the popcount of the smaller
   bits of the word.
4. Slot arrays.  ``(source, slot div 16)`` keys a run; its children go to the places of an
   array by ``slot mod 16`` and its digest is a node of the next level.  The sources'
   roots are reduced to one root in the same way.

Proofs are handed down from the root: a run joined with its own path gives its children
their paths (the siblings to the left and right at each level), so the leaves
themselves take part in two narrow shuffles and no join of whole texts exists.

Edge cases: a null column counts as ``-``; a null text or source is not an empty one; a
null doc_id comes before all others; rows that share source and doc_id all count,
ordered by their digests, and equal rows take consecutive slots; an empty table gives no
rows; further columns are ignored; texts of any length are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.operators.rank import rank_many
from paneltide.session import materialize

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: children of a node
ARITY = 16
#: bits of a directory level: 2**12 entries of the level below
FAN_BITS = 12
#: equal rows written by one task
COPIES = 4096

SCHEMA = ("doc_id long, source string, leaf string, probe string, slot long, "
          "path array<struct<left:string,right:string>>, subroot string, root string")


def digest(*values: Column) -> Column:
    """SHA-256 of a record: ``-`` for a null, else UTF-8 byte count, ``:`` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _source_key(c) -> Column:
    """A key without nulls that sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def leaves(docs: DataFrame, probe_text: Column) -> DataFrame:
    """key, doc_id, leaf and probe (the leaf with ``probe_text`` for its text)."""
    d = docs.select(*FIELDS, probe_text.alias("_probe"))
    rest = [F.col(c) for c in FIELDS[:-1]]
    return d.select(_source_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                    digest(*rest, F.col("text")).alias("leaf"), digest(*rest, F.col("_probe")).alias("probe"))


# --- bitmaps and their directory -----------------------------------------------------------

_BIT = "cast(doc_id & 63 as int)"


def _words(rows: DataFrame) -> DataFrame:
    """key, word, rows and the word's bits; the null ids of a source are a null word."""
    return (rows.groupBy("key", F.shiftright("doc_id", 6).alias("word"))
            .agg(F.count(F.lit(1)).alias("rows"), F.bit_or(F.expr(f"shiftleft(1L, {_BIT})")).alias("bits")))


def _same(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null equal to null; b's columns are dropped."""
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in cols})
    on = [a[c].eqNullSafe(b[f"_b_{c}"]) for c in cols]
    return a.join(b, on, how).drop(*[f"_b_{c}" for c in cols])


def directory(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(key, cell, before): rows of the key in smaller cells.  ``low`` and ``high`` bound
    the cells of all keys; a null cell comes first."""
    running = Window.orderBy(F.asc_nulls_first("cell")).rowsBetween(Window.unboundedPreceding, -1)

    def inside(*part: str) -> Column:
        return F.coalesce(F.sum("rows").over(running.partitionBy(*part)), F.lit(0)).alias("before")

    if high - low < 1 << FAN_BITS:
        return cells.select("key", "cell", inside("key"))
    tall = cells.withColumn("up", F.shiftright("cell", FAN_BITS))
    above = directory(tall.groupBy("key", F.col("up").alias("cell")).agg(F.sum("rows").alias("rows")),
                      low >> FAN_BITS, high >> FAN_BITS)
    own = tall.select("key", "cell", "up", inside("key", "up"))
    both = _same(own, above.select("key", F.col("cell").alias("up"), F.col("before").alias("_above")), ["key", "up"])
    return both.select("key", "cell", (F.col("before") + F.col("_above")).alias("before"))


def slots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with their slot and ``n``, the number of rows of their source;
    the sources with ``n``)."""
    words = materialize(_words(rows))
    low, high = words.agg(F.min("word"), F.max("word")).first()
    sizes = materialize(words.groupBy("key").agg(F.sum("rows").alias("n")))
    before = directory(words.select("key", F.col("word").alias("cell"), "rows"), low or 0, high or 0)
    ranked = _same(words, before.withColumnRenamed("cell", "word"), ["key", "word"]).join(sizes, "key")
    ranked = materialize(ranked)
    placed = _same(rows.withColumn("word", F.shiftright("doc_id", 6)), ranked, ["key", "word"])
    single = F.col("rows") == F.bit_count(F.coalesce("bits", F.lit(0)))     # no id of the word is repeated
    plain = placed.where(single).select(
        "key", "n", (F.col("before") + F.expr(f"bit_count(bits & ~shiftleft(-1L, {_BIT}))")).alias("slot"), "doc_id", "leaf", "probe")
    if ranked.where(~single).isEmpty():
        return plain, sizes
    return plain.unionByName(_repeated(placed.where(~single))), sizes


def _repeated(placed: DataFrame) -> DataFrame:
    """Slots inside words with repeated (or null) ids: ordered by id, then digest, through the
    distributed rank; the copies of one row take consecutive slots."""
    place = F.coalesce(F.lpad(F.expr(f"cast({_BIT} as string)"), 2, "0"), F.lit(""))
    one = placed.withColumn("_v", F.concat(place, "leaf", "probe"))
    ranked = rank_many(one, [("_v", "_rank", None)], by=["key", "word"])
    same = ranked.groupBy("key", "word", "n", "rows", "before", "doc_id", "leaf", "probe", "_rank").agg(F.count(F.lit(1)).alias("copies"))
    first = F.col("before") + F.col("rows") - (F.col("_rank") - 1) - F.col("copies")
    blocks = same.select("key", "n", first.alias("first"), "copies", "doc_id", "leaf", "probe",
                         F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("block"))
    blocks = blocks.repartition("key", "first", "block")
    return blocks.select("key", "n", F.explode(F.expr(
        f"sequence(first + block * {COPIES}, first + least(copies, (block + 1) * {COPIES}) - 1)")).alias("slot"), "doc_id", "leaf", "probe")


# --- the tree ------------------------------------------------------------------------------


def _runs(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(key, n, slot, kids, hash): each run of ``ARITY`` nodes as an array keyed by place.
    A key with one node is done: its run hands the digest on."""
    kid = F.struct(F.col("hash"), *payload)
    at = F.expr(f"cast(slot % {ARITY} as int)")
    grouped = nodes.groupBy("key", "n", F.expr(f"slot div {ARITY}").alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct(at, kid))).alias("_at"))
    kids = grouped.select("key", "n", "slot", F.transform(F.sequence(F.lit(0), F.size("_at") - 1), lambda i: F.col("_at")[i]).alias("kids"))
    hashed = F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(
        F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256))
    return kids.withColumn("hash", hashed)


def reduce_levels(nodes: DataFrame, most: int, payload: list[str]) -> list[DataFrame]:
    """The runs of every level, written one by one; ``most`` is the largest ``n``.  The
    last level has one run for each key; its hash is the key's root."""
    levels, m = [], most
    while not levels or m > 1:
        levels.append(materialize(_runs(nodes, payload)))
        m = -(-m // ARITY)
        nodes = levels[-1].select("key", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "slot", "hash")
        payload = []
    return levels


def hand_down(levels: list[DataFrame], path: DataFrame, carried: list[str]) -> DataFrame:
    """One row per node below the first level: ``kid``, its slot, its path to the root and the
    carried columns.  ``path``: key, path and the carried columns of each key's root."""
    path = path.withColumn("slot", F.lit(0).cast("long"))
    for runs in reversed(levels):
        both = runs.drop("hash").join(path, ["key", "slot"])
        both = both.select("key", "n", "slot", "path", *carried, "kids", F.posexplode("kids").alias("at", "kid"))

        def side(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda k: k["hash"]), "")

        here = F.struct(side(F.expr("slice(kids, 1, at)")).alias("left"), side(F.expr(f"slice(kids, at + 2, {ARITY})")).alias("right"))
        path = both.select("key", (F.col("slot") * ARITY + F.col("at")).alias("slot"), "kid", *carried,
                           F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(here), "path")).alias("path"))
    return path


def manifest(docs: DataFrame, probe_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, leaf, probe (the leaf as it would be with
    ``probe_text``), slot in its source, path (siblings left and right of it, level by
    level up to the root), subroot and root."""
    spark = docs.sparkSession
    rows = materialize(leaves(docs, F.col("text") if probe_text is None else probe_text))
    placed, sizes = slots(rows)
    sources, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if not sources:
        return spark.createDataFrame([], SCHEMA)
    levels = reduce_levels(placed.withColumnRenamed("leaf", "hash"), most, ["doc_id", "probe"])
    subroots = levels[-1].select("key", "hash")
    ordered = rank_many(subroots, [("key", "_rank", None)], materialize_input=False)
    top = reduce_levels(ordered.select(F.lit("").alias("key"), F.lit(sources).cast("long").alias("n"),
                                       (F.lit(sources).cast("long") - F.col("_rank")).alias("slot"), "hash", F.col("key").alias("of")), sources, ["of"])
    start = top[-1].select("key", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"), F.col("hash").alias("root"))
    of_sources = hand_down(top, start, ["root"]).select(
        F.col("kid.of").alias("key"), "path", "root", F.col("kid.hash").alias("subroot"))
    down = hand_down(levels, of_sources, ["root", "subroot"])
    return down.select(F.col("kid.doc_id").alias("doc_id"), F.expr("if(key = '', null, substr(key, 2))").alias("source"),
                       F.col("kid.hash").alias("leaf"), F.col("kid.probe").alias("probe"), "slot", "path", "subroot", "root")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
