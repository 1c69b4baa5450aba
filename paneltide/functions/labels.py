"""Label builders as native expressions (no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_

# Position vocabulary and groupings.
FIVE_POSITIONS = ("PG", "SG", "SF", "PF", "C")
THREE_CLASS = {"PG": "Guard", "SG": "Guard", "SF": "Wing", "PF": "Big", "C": "Big"}
STAR_TOKEN = "AS"
AWARD_TOKENS = ("NBA", "MVP")


def contains_ci(c, token: str) -> Column:
    """Case-insensitive substring test; NULL text -> 0."""
    return F.coalesce(F.upper(col_(c)).contains(token.upper()), F.lit(False)).cast("int")


def contains_any_ci(c, tokens=AWARD_TOKENS) -> Column:
    """1 if the upper-cased text contains any token; non-text / NULL -> 0."""
    u = F.upper(col_(c))
    hit = F.lit(False)
    for t in tokens:
        hit = hit | u.contains(t.upper())
    return F.coalesce(hit, F.lit(False)).cast("int")


def _lookup(mapping: dict, c) -> Column:
    """Exact match of a normalised position, else the first token of a
    hyphenated hybrid, looked up in a map literal (one normalisation per
    row; a nested CASE would repeat it per branch)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    p = F.upper(F.trim(col_(c)))
    return F.coalesce(F.try_element_at(m, p),
                      F.when(p.contains("-"), F.try_element_at(m, F.split_part(p, F.lit("-"), F.lit(1)))))


def position_five(c) -> Column:
    """Trim + upper; keep one of five positions, else the first token of a
    hyphenated hybrid when that is one, else NULL."""
    return _lookup({p: p for p in FIVE_POSITIONS}, c)


def position_three(c) -> Column:
    """Guard / Wing / Big from the five-way position (NULL when unmappable)."""
    return _lookup(THREE_CLASS, c)
