"""Secret scan by corpus-wide ownership frequency, in SQL functions only.

Each finding's value is hashed.  Hashes are aggregated over the corpus to the numbers
of distinct repositories and owners that hold them.  A value that many owners share
or that stands in many repositories is a copied example, even if one owner holds them all;
one that ``OWNERS`` owners and ``REPOS`` repositories at most hold, and that looks random, is
owner-specific and live-looking.  Base findings are always reported; findings of the
further formats (``KNOWN``) are added only when they are owner-specific.

Counting goes by (hash, owner, repository), then (hash, owner), then hash, each with
partial sums before its shuffle, so a value that a third of all rows hold is spread.
Only rows that hold a candidate, without their texts, are shuffled.

Edge cases: null text is empty: no findings; very long texts are scanned whole;
repeated rows give repeated results and count as one repository; a null owner is
one owner of its own, and a null repository id one repository; an empty table gives
no rows; further columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.session import materialize

from .common import sheltered
from .native_spans import span_text, with_spans

#: a value held by more owners than this is a copied example
OWNERS = 2
#: a value in more repositories than this is a copied example, whoever owns them
REPOS = 10
#: different characters of a value that looks random; one of letters of one case or digits alone needs
#: LONG_VARIED of them, as ordinary words have few
VARIED, LONG_VARIED = 6, 12
MASK = "[SECRET]"

KINDS = ["assign", "access", "hex"]
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: further public credential formats: platform, payment, chat and cloud tokens, signed web tokens
KNOWN = (r"gh[pousr]_[A-Za-z0-9]{36,}|sk[-_](?:live_|test_)?[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
         r"|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def findings(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``_row`` (a number per row) and ``found``: all candidates as
    array<struct<start, kind, name, end, value>>, sorted by start, then kind.  Written
    once: filters on ``found`` must not be pushed into the expressions that make it."""
    df = docs.select(*[F.col(c) for c in keep], F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    df = with_spans(df, "_assign", "_text", ASSIGN, 2)
    df = with_spans(df, "_access", "_text", ACCESS)
    df = with_spans(df, "_hex", "_text", HEX)
    df = with_spans(df, "_known", "_text", KNOWN)

    def of(name: str, i: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.lit(name[1:]).alias("name"),
                                                    s["end"].alias("end"), s["value"].alias("value")))

    sure = F.filter("_assign", lambda s: F.length(s["value"]) >= 6)
    df = df.withColumn("_assign", sure)
    found = F.array_sort(F.concat(*(of(n, i) for i, n in enumerate(["_assign", "_access", "_hex", "_known"]))))
    return materialize(df.withColumn("found", found).drop("_text", "_assign", "_access", "_hex", "_known"))


def _varied(value: Column) -> Column:
    """Does the value look random: varied characters of two kinds at least (small letters,
    capitals behind the first character, digits), or many different ones?"""
    different = F.size(F.array_distinct(F.split(value, "")))
    kinds = [value.rlike("[a-z]"), F.substr(value, F.lit(2)).rlike("[A-Z]"), value.rlike("[0-9]")]
    mixed = sum((k.cast("int") for k in kinds[1:]), kinds[0].cast("int")) >= 2
    return ((different >= VARIED) & mixed) | (different >= LONG_VARIED)


def ownership(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """(hash, repos, owners) of every candidate value of the corpus."""
    held = (found.where(F.size("found") > 0)
            .select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode(F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["value"])))).alias("hash")))
    return (held.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
            .groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners")))


def judged(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """(_row, live): the hashes of each row's owner-specific, live-looking values."""
    live = ownership(found, repo, owner).where((F.col("owners") <= OWNERS) & (F.col("repos") <= REPOS)).select("hash")
    each = (found.where(F.size("found") > 0)
            .select("_row", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
            .where(_varied(F.col("value"))).select("_row", F.xxhash64("value").alias("hash")))
    return each.join(live, "hash").groupBy("_row").agg(F.collect_set("hash").alias("live"))


def _only(kinds: Column, name: str) -> Column:
    return F.filter(kinds, lambda k: k == name)


def scan(docs: DataFrame, key: str = "doc_id", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    found = findings(docs.withColumn("_repo", F.col(repo)).withColumn("_owner", F.col(owner)), [key, "_repo", "_owner"])
    df = found.join(judged(found, "_repo", "_owner"), "_row", "left")
    live = F.coalesce("live", F.array().cast("array<bigint>"))
    is_live = lambda s: F.array_contains(live, F.xxhash64(s["value"]))
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    every = F.filter("found", lambda s: (s["kind"] < len(KINDS)) | is_live(s))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: span_text(s["name"], s)), ",")
    kinds = F.transform("found", lambda s: s["name"])
    counts = [F.size(_only(kinds, n)).cast("long").alias(f"n_{n}") for n in KINDS]
    n_live = F.size(F.filter("found", is_live)).cast("long")
    return df.select(key, *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"),
                     n_live.alias("n_live"), (F.size(every) - F.size(F.filter(every, is_live))).cast("long").alias("n_example"))


def redact(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """``docs`` with every found owner-specific, live-looking value replaced by ``MASK``, at
    its own place alone: equal characters elsewhere stay, and so do copied examples.  ``n_chars``, if there, follows the text that changed."""
    inner, restored = sheltered(docs, [repo, owner, "text", "n_chars"])
    found = findings(inner, inner.columns)
    hit = found.where(F.size("found") > 0).join(judged(found, repo, owner), "_row", "left")
    # a value ends where its match ends
    spans = F.transform(F.filter("found", lambda s: F.array_contains("live", F.xxhash64(s["value"]))),
                        lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end")))

    def masked(done: Column, s: Column) -> Column:
        """The text up to the end of span ``s``; a span inside one before it adds nothing."""
        added = F.when(s["start"] >= done["at"], F.concat(F.substring("text", done["at"] + 1, s["start"] - done["at"]), F.lit(MASK))).otherwise("")
        return F.when(s["end"] <= done["at"], done).otherwise(F.struct(F.concat(done["out"], added).alias("out"), s["end"].alias("at")))

    cut = F.aggregate(F.array_sort(F.array_distinct(spans)), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), masked)
    hit = hit.withColumn("_cut", F.when(F.col("live").isNotNull(), cut))
    hit = hit.withColumn("_new", F.when(F.col("live").isNull(), F.col("text")).otherwise(
        F.concat("_cut.out", F.substring("text", F.col("_cut.at") + 1, F.length("text")))))
    if "n_chars" in docs.columns:
        n = docs.schema["n_chars"].dataType
        hit = hit.withColumn("n_chars", F.when(F.col("live").isNotNull(), F.length("_new").cast(n)).otherwise(F.col("n_chars")))
    hit = hit.withColumn("text", F.col("_new"))
    return restored(found.where(F.size("found") == 0).select(*inner.columns).unionByName(hit.select(*inner.columns)))
