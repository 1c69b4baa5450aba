"""File sources with explicit schemas: CSV with header, directory globs,
period partitions, file provenance and a quarantine for malformed records.

Schemas are always given (never inferred): a season whose outcome column
is missing must not turn an integer column into a float one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import materialize

CORRUPT = "_corrupt_record"
# A whole path segment: "2015-2016.csv", "2015-2016/" or "season=2015-2016/";
# the greedy prefix takes the last such segment, so ids elsewhere in the path
# (e.g. a uuid containing "1234-5678") never match.
SEASON_PATTERN = r".*/(?:[^/=]*=)?(\d{4}-\d{4})(?:\.[A-Za-z0-9]+)?(?:/|$)"


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", True) if recursive else r


def read_csv(spark: SparkSession, path: str, schema: StructType, glob: str | None = "*.csv",
             recursive: bool = False, aliases: dict[str, str] | None = None, required=None,
             quarantine: bool = False) -> DataFrame:
    """CSV files with a header, read by column name.

    Every file may order its columns differently, carry any number of further ones, or spell
    a name in another way (``aliases``: spelling -> name).  Rows that hold all ``required`` names
    (default: the whole schema) are headers, also where a file repeats them; a file
    without a header, or without a required column, is an error.  Values that do not
    parse are NULL, and with ``quarantine`` the row's raw fields stand in
    ``_corrupt_record``.  The file's path stays readable as ``file_path``.

    One pass over the lines finds the header of each file (a small table, written once) and
    with it the widest one; the body is then read with that many columns."""
    required = [f.name for f in schema.fields] if required is None else list(required)
    spellings = {name: [name, *(a for a, n in (aliases or {}).items() if n == name)] for name in required}

    def spelled(fields: Column) -> Column:
        names = F.transform(fields, lambda v: F.trim(v))
        if not aliases:
            return names
        known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        return F.transform(names, lambda v: F.coalesce(F.try_element_at(known, v), v))

    def holds_all(names: Column) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0

    lines = _reader(spark, glob, recursive).text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    near = F.lit(True)              # a cheap test first: some spelling of every name stands in the line
    for name in required:
        near = near & reduce(lambda a, b: a | b, [F.contains(F.col("value"), F.lit(s)) for s in spellings[name]])
    bare_fields = F.transform(F.split("value", ","), lambda v: F.btrim(v, F.lit(' "')))
    looks = F.when(near, holds_all(spelled(bare_fields))).otherwise(F.lit(False))
    found = materialize(lines.groupBy("file_path").agg(F.max(F.when(looks, F.col("value"))).alias("_line")))
    bare = found.where(F.col("_line").isNull()).select("file_path").limit(5).collect()
    if bare:
        raise ValueError(f"columns {required} are missing in {[b[0] for b in bare]}")
    width = found.agg(F.max(F.size(F.split("_line", ",")))).first()[0] or 1
    fields = [f"_c{i}" for i in range(width)]
    columns = ", ".join(f"{c} string" for c in fields)
    headers = found.withColumn("_h", F.from_csv("_line", F.lit(columns))) \
        .select("file_path", spelled(F.array(*[F.col(f"_h.{c}") for c in fields])).alias("_names"))
    raw = _reader(spark, glob, recursive).schema(columns).option("header", False).csv(path) \
        .select(F.col("_metadata.file_path").alias("file_path"), F.array(*fields).alias("_v"))
    body = raw.where(~holds_all(spelled(F.col("_v")))).join(headers, "file_path")

    def value(name: str) -> Column:
        return F.get("_v", F.array_position("_names", name).cast("int") - 1)

    cols = [value(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    if quarantine:
        bad = [value(f.name).isNotNull() & value(f.name).try_cast(f.dataType).isNull() for f in schema.fields]
        broken = bad[0]
        for b in bad[1:]:
            broken = broken | b
        cols.append(F.when(broken, F.concat_ws(",", "_v")).alias(CORRUPT))
    return body.select(*cols, "file_path")


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise RuntimeError(f"no rows loaded from {what}")
    return df


def file_season(col: str = "file_path") -> Column:
    """Period label taken from the file's name or its partition directory
    (``YYYY-YYYY``), never from other parts of the path."""
    return F.regexp_extract(F.col(col), SEASON_PATTERN, 1)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV header (reads the first line only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def with_quarantine(spark: SparkSession, path: str, schema: StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of CSV files: records whose values do not parse land in the
    quarantine frame with their raw text instead of failing the job or being dropped."""
    df = read_csv(spark, path, schema, quarantine=True, **options).drop("file_path")
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def parse_json_quarantine(df: DataFrame, text_col: str, schema: StructType, keys=()) -> DataFrame:
    """Parse a JSON text column; rows that do not parse keep their raw text in
    ``_corrupt_record`` (PERMISSIVE), so callers split good from bad rows."""
    full = StructType(list(schema.fields) + [StructField(CORRUPT, _string(), True)])
    parsed = F.from_json(F.col(text_col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return df.select(*keys, parsed.alias("_p")).select(*keys, "_p.*")


def _string():
    from pyspark.sql.types import StringType
    return StringType()
