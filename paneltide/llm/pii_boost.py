"""Personal data by candidate gradient boosting, in SQL functions on the main path.

Base spans (well-formed emails, IP addresses, card and phone numbers) are found by
their patterns and always stay.  High-recall generators propose further, overlapping
candidates: spelled-out emails, addresses with odd separators, numbers without a
country prefix.  Each candidate has format features (digits, separators, glued
neighbours, groups) and context features (words nearby that speak for or against it).

Labels are weak and come from the strict patterns and the context: a candidate is
personal if it overlaps a base span of its kind or only words that speak for its kind are
near, not personal if it overlaps none and only words that speak against it are near, and
unlabelled otherwise.  What gives a label away (the plus sign, the checksum, those words)
is withheld from the trees, so they learn how personal data looks and judge labelled
and unlabelled candidates alike.

Boosted trees learn on a sample of about ``TRAIN_ROWS`` labelled candidates of each kind, the
ones of smallest hash over the whole corpus.  A threshold per kind is calibrated on all
other labelled candidates of the corpus, by one aggregate of their margins, to at least
``PRECISION`` among ``EVIDENCE`` or more; a kind without such a threshold adds nothing.

The trees are turned into one SQL expression, so scoring is part of the projection
that writes the result: rows are not exploded and not shuffled.

Edge cases: null text is empty: no spans; very long texts are scanned whole; a
sample without both labels trains nothing and adds nothing; repeated rows give repeated results; an empty table gives no
rows; further columns are ignored by :func:`scan`.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.session import materialize

from .native_spans import in_chunks, overlapping, span_text, with_spans

TRAIN_ROWS = 20_000
PRECISION = 0.98
EVIDENCE = 50
TREES, DEPTH = 12, 3
#: code points of context on each side of a candidate, up to the next one
CONTEXT = 40

KINDS = ["email", "ip", "card", "phone"]
#: the contract's patterns; a match can only begin where a run begins or the last
#: match ended, and repeats are possessive, which changes no match but keeps long runs linear
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: high-recall generators of each kind
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64}){1,8}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.,:_\x20][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{2,6}){2,5}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[\x20(]{0,2}[0-9]{1,4}(?:[\x20().-]{1,2}[0-9]{2,5}){2,4}(?![0-9])",
}
#: fixed values: words that speak for a kind, and words that speak for another reading
FOR = {
    "email": "mail|e-mail|contact|kontakt|write|schreib|correo|courriel",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|master|credit|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|mobile|fax|telefon|handy|anruf|llama",
}
AGAINST = "version|isbn|order|invoice|ref|page|seite|rfc|build|serial|figure|table|section"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The checksum of a digit string, whatever its length."""
    odd = F.split(F.reverse(digits), "")
    value = F.transform(odd, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    """A digit string of any length is at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def _valid(kind: str, s: Column) -> Column:
    value = s["match"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


#: the last two give labels, the trees learn from the others
FEATURES = ["kind", "length", "digits", "separators", "groups", "distinct", "brackets", "glued_before", "glued_after", "words_for", "words_against"]


def _features(kind: str, i: int, s: Column) -> Column:
    v, before, after = s["match"], s["before"], s["after"]
    near = F.lower(F.concat_ws(" ", before, after))
    digits = _digits(v)
    gone = F.length(v) - F.length(digits)
    one = lambda c: c.cast("double")
    return F.array(
        F.lit(float(i)), one(F.length(v)), one(F.length(digits)), one(gone), one(F.size(F.split(v, "[^A-Za-z0-9]+"))),
        one(F.size(F.array_distinct(F.split(digits, "")))), one(F.length(v) - F.length(F.regexp_replace(v, r"[()\[\]]", ""))),
        one(before.rlike("[A-Za-z0-9]$")), one(after.rlike("^[A-Za-z0-9]")),
        one(near.rlike(rf"\b(?:{FOR[kind]})")), one(near.rlike(rf"\b(?:{AGAINST})")))


def findings(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``_row``, ``base`` (array<struct<kind, start, end>>, by kind and
    start) and ``candidates`` (array<struct<kind, start, end, features, personal>>).  Written
    once: filters on them must not be pushed into the expressions that make them."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    for kind, regex in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        df = with_spans(df, f"_b_{kind}", "_text", regex)
        df = df.withColumn(f"_b_{kind}", F.filter(f"_b_{kind}", _judge(kind)))
    for i, kind in enumerate(KINDS):
        df = with_spans(df, f"_g_{kind}", "_text", GENERATORS[kind], context=CONTEXT).withColumn(f"_c_{kind}", in_chunks(f"_b_{kind}"))
        df = df.withColumn(f"_g_{kind}", F.transform(f"_g_{kind}", _candidate(kind, i, f"_c_{kind}")))
    base = F.concat(*(F.transform(f"_b_{kind}", _numbered(i)) for i, kind in enumerate(KINDS)))
    return materialize(df.select(*keep, "_row", base.alias("base"), F.concat(*(f"_g_{k}" for k in KINDS)).alias("candidates")))


def _judge(kind: str):
    return lambda s: _valid(kind, s)


def _numbered(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _candidate(kind: str, i: int, base: str):
    def made(s: Column) -> Column:
        return F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        _features(kind, i, s).alias("features"), overlapping(base, s).alias("personal"))
    return made


def _tree_sql(debug: str) -> str:
    """A regression tree, as Spark prints it, as a SQL expression over an array ``f``."""
    lines = iter([x.strip() for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> str:
        line = next(lines)
        if line.startswith("Predict"):
            return line.split(":")[1].strip() + "D"
        feature, value = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return f"CASE WHEN f[{feature}] <= {value}D THEN {low} ELSE {node()} END"

    return node()


def _label() -> Column:
    """1: personal, 0: not, null: unlabelled."""
    speaks_for, against = (F.element_at("c.features", FEATURES.index(x) + 1) > 0 for x in ("words_for", "words_against"))
    return F.when(F.col("c.personal") | (speaks_for & ~against), 1.0).when(against & ~speaks_for, 0.0)


def train(found: DataFrame) -> tuple[str, dict[int, float]] | None:
    """(margin as SQL over an array ``f``, threshold per kind): trees from a bounded sample,
    thresholds from all other labelled candidates."""
    order = F.pmod(F.xxhash64("_row", "c.kind", "c.start"), F.lit(1 << 40))
    each = (found.where(F.size("candidates") > 0).select("_row", F.explode("candidates").alias("c"))
            .select(order.alias("h"), "c.kind", F.slice("c.features", 1, len(FEATURES) - 2).alias("features"), _label().alias("label"))
            .where("label IS NOT NULL"))
    # the smallest hashes of each kind, half of them at most, are learnt from; no candidate is shuffled
    bound = F.lit(0)
    for r in each.groupBy("kind").count().collect():
        bound = F.when(F.col("kind") == r["kind"], int((1 << 40) * min(0.5, TRAIN_ROWS / r["count"]))).otherwise(bound)
    # equal candidates are one weighted row
    fit = materialize(each.where(F.col("h") < bound).groupBy("kind", "features", "label").agg(F.count("*").cast("double").alias("weight"))
                      .withColumn("x", array_to_vector("features")))
    if fit.select(F.count_distinct("label")).first()[0] < 2:
        return None
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(fit)
    margin = " + ".join(f"{w}D * ({_tree_sql(t.toDebugString)})" for w, t in zip(model.treeWeights, model.trees))
    seen = (each.where(F.col("h") >= bound).select("kind", "label", F.expr(f"transform(array(features), f -> {margin})[0]").alias("margin"))
            .groupBy("kind", F.round("margin", 3).alias("margin")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect())
    limits: dict[int, float] = {}
    for kind in {r["kind"] for r in seen}:
        n = good = 0.0
        for r in sorted((r for r in seen if r["kind"] == kind), key=lambda r: -r["margin"]):
            n, good = n + r["n"], good + r["good"]
            if n >= EVIDENCE and good < PRECISION * n:
                break
            if n >= EVIDENCE:
                limits[kind] = r["margin"]
    return margin, limits


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = findings(docs, [key])
    model = train(found)
    added = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if model and model[1]:
        margin, limits = model
        bar = " ".join(f"WHEN {k} THEN {v - 0.0005}D" for k, v in limits.items())
        score = f"transform(array(c.features), f -> {margin})[0]"
        # a candidate adds to the base where it overlaps no base span
        good = F.expr(f"filter(candidates, c -> NOT c.personal AND {score} >= CASE c.kind {bar} ELSE double('Infinity') END)")
        found = found.withColumn("_chunks", in_chunks("base")).withColumn("_good", good)
        added = F.transform(F.filter("_good", lambda c: ~overlapping("_chunks", c)),
                            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    df = found.withColumn("added", added)
    every = F.array_sort(F.concat("base", "added"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: span_text(F.get(names, s["kind"]), s)), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(_only(kinds, i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select(key, *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                     text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _only(kinds: Column, i: int) -> Column:
    return F.filter(kinds, lambda k: k == i)
