"""Row-level cleaning steps of table ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.nulls import try_number


def drop_repeated_headers(df: DataFrame, col: str, header_text: str | None = None) -> DataFrame:
    """Scraped tables repeat their header every few rows: drop rows whose
    ``col`` equals the header text (NULL rows are kept)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(header_text or col)))


def coerce_numeric(df: DataFrame, keep_text=(), int_cols=()) -> DataFrame:
    """Every column except ``keep_text`` to double (``int_cols`` to int);
    text cleaned with trim; unparsable values become NULL."""
    out = {}
    for c in df.columns:
        if c in keep_text:
            out[c] = F.trim(F.col(c).cast("string"))
        elif c in int_cols:
            out[c] = try_number(c, "int")
        else:
            out[c] = try_number(c, "double")
    return df.withColumns(out)


def strip_marker(c, marker: str = "*"):
    """Remove a literal marker (e.g. the playoff asterisk) and trim."""
    return F.trim(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(marker), F.lit("")))


def audited_filter(df: DataFrame, steps: list[tuple[str, object]], name: str = "audit"):
    """Apply filters in order and record, for each step, how many rows it
    dropped, as observed metrics of the job that consumes the result (no
    extra pass).  Returns (filtered frame, Observation); ``obs.get`` holds
    ``rows_in`` and ``dropped_<step>`` after the first action."""
    cond_so_far = F.lit(True)
    metrics = [F.count(F.lit(1)).alias("rows_in")]
    for label, cond in steps:
        c = F.expr(cond) if isinstance(cond, str) else cond
        metrics.append(F.count_if(cond_so_far & ~F.coalesce(c, F.lit(False))).alias(f"dropped_{label}"))
        cond_so_far = cond_so_far & F.coalesce(c, F.lit(False))
    obs = Observation(f"{name}_{uuid.uuid4().hex[:12]}")   # unique per call
    observed = df.observe(obs, *metrics)
    return observed.where(cond_so_far), obs
