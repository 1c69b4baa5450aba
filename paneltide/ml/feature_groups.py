"""Named feature groups of the team model (safe column names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feature groups and their columns.
FEATURE_GROUPS = {
    "basic_box": ["pts", "fga", "fta", "trb", "ast", "stl", "blk", "tov", "pf"],
    "basic_eff": ["ts_pct", "efg_pct_f", "ast_to_ratio", "prev_win_pct"],
    "four_factors": ["efg_factor", "tov_factor", "oreb_factor", "ftr_factor"],
    "full_box": ["fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta",
                 "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts"],
    "rolling_box": ["pts_3y", "ast_3y", "trb_3y", "stl_3y", "blk_3y"],
    "trend": ["win_pct_3y", "win_pct_5y", "win_pct_trend"],
}
TREND_ONLY = ["prev_win_pct", "win_pct_3y", "win_pct_5y", "win_pct_trend"]


def columns_for(groups, available=None) -> list[str]:
    """Sorted, de-duplicated union of the groups' columns (present ones only)."""
    cols = {c for g in groups for c in FEATURE_GROUPS[g]}
    if available is not None:
        cols &= set(available)
    return sorted(cols)


def group_map() -> Column:
    """The groups as a map literal: name -> array of column names."""
    kv = []
    for k, v in FEATURE_GROUPS.items():
        kv += [F.lit(k), F.array(*[F.lit(c) for c in v])]
    return F.create_map(*kv)


def feature_union(groups_text) -> Column:
    """'a|b' -> sorted distinct union of the groups' columns (array)."""
    g = F.split(groups_text, r"\|")
    parts = F.transform(g, lambda x: F.coalesce(
        F.try_element_at(group_map(), x), F.raise_error(F.concat(F.lit("unknown feature group "), x)).cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(parts)))
