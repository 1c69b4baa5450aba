"""Places of regular-expression matches with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: lengths summed one by one; whole chunks of this many come from chunk sums
CHUNK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def with_spans(df, name: str, text: str, regex: str, group: int = 0, context: int = 0):
    """``df`` with the column ``name``: array<struct<start, end, value>> of all
    leftmost non-overlapping matches in ``text``; start and end are code points, end
    exclusive; value is the given group.  With ``context``, ``before`` and ``after`` hold up to
    that many code points between the match and its neighbours.

    The pieces between the matches and the matches themselves give the places as
    running sums, in steps of whole chunks, so a text with m matches costs about
    m * CHUNK / 2 additions, not m * m.  Write the result before filtering or exploding the
    column: a filter pushed below it would repeat all of these expressions."""
    p, m, v, s, c = (f"_{name}_{x}" for x in ("pieces", "matches", "values", "steps", "chunks"))
    none = F.array().cast("array<string>")
    df = df.withColumn(p, F.split(text, regex, -1))
    hit = F.size(p) > 1
    df = df.withColumn(m, F.when(hit, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none))
    if group:
        df = df.withColumn(v, F.when(hit, F.regexp_extract_all(text, F.lit(regex), F.lit(group))).otherwise(none))
    else:
        v = m
    # steps[i]: from the start of match i - 1 (of the text, for i = 0) to the start of match i
    df = df.withColumn(s, F.transform(m, lambda _, i: F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)))
    df = df.withColumn(c, F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / CHUNK).cast("int")),
                                      lambda k: _sum(F.slice(s, k * CHUNK + 1, F.lit(CHUNK)))))
    place = lambda i: (_sum(F.slice(c, F.lit(1), F.floor(i / CHUNK).cast("int")))
                       + _sum(F.slice(s, (F.floor(i / CHUNK) * CHUNK).cast("int") + 1, (i % CHUNK) + 1)))

    def around(i: Column) -> list[Column]:
        if not context:
            return []
        return [F.right(F.get(p, i), F.lit(context)).alias("before"), F.left(F.get(p, i + 1), F.lit(context)).alias("after")]

    found = F.transform(m, lambda x, i: F.struct(place(i).alias("start"), (place(i) + F.length(x)).alias("end"),
                                                  F.get(v, i).alias("value"), x.alias("match"), *around(i)))
    kind = "start:int,end:int,value:string,match:string" + (",before:string,after:string" if context else "")
    return df.withColumn(name, F.when(hit, found).otherwise(F.array().cast(f"array<struct<{kind}>>"))).drop(p, m, v, s, c)


def in_chunks(spans: str) -> Column:
    """The spans of a column in chunks with their bounds, for :func:`overlapping`."""
    part = lambda k: F.slice(spans, k * CHUNK + 1, F.lit(CHUNK))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda k: F.struct(
        part(k).alias("part"), F.array_min(F.transform(part(k), lambda s: s["start"])).alias("low"),
        F.array_max(F.transform(part(k), lambda s: s["end"])).alias("high")))


def overlapping(chunks: str, s: Column) -> Column:
    """Does the span ``s`` overlap a span of the chunks?  Chunks out of reach are not looked into."""
    return F.exists(chunks, lambda c: (c["low"] < s["end"]) & (s["start"] < c["high"]) & F.exists(
        c["part"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def span_text(kind: str | Column, s: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
