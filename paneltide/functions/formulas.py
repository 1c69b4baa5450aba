"""Derived-metric formulas as native Column expressions (whole-stage codegen,
no Python per row).  Column names follow the safe naming of the panel schema
(``fg``, ``fga``, ``p3``, ``p3a``, ``fta`` ...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_, eps_div, safe_div

# Fixed values that results must agree on (formula constants).
FREE_THROW_WEIGHT = 0.44      # possessions used by a free-throw attempt
THREE_POINT_BONUS = 0.5       # extra credit of a made three in effective FG
TEAM_EPS = 1e-8               # denominator epsilon of the team feature builder
PLAYER_EPS = 1e-6             # denominator epsilon of the per-36 player features
PER_MINUTES = 36.0            # per-36-minute rates
WITHIN1_WEIGHT = 0.7          # overall score = 0.7 * within-1 + 0.3 * exact
EXACT_WEIGHT = 0.3


def win_pct(wins="wins", losses="losses") -> Column:
    """W / (W + L); NULL when there are no games."""
    w, l = col_(wins).cast("double"), col_(losses).cast("double")
    return safe_div(w, w + l)


def shooting_pcts(zero_fill: bool = True) -> dict[str, Column]:
    """FG%, 3P%, 2P%, FT% and eFG% from summed totals (0 when undefined)."""
    d = 0.0 if zero_fill else None
    return {
        "fg_pct": safe_div("fg", "fga", d),
        "p3_pct": safe_div("p3", "p3a", d),
        "p2_pct": safe_div("p2", "p2a", d),
        "ft_pct": safe_div("ft", "fta", d),
        "efg_pct": safe_div(F.col("fg") + THREE_POINT_BONUS * F.col("p3"), F.col("fga"), d),
    }


def effective_fg(eps: float = TEAM_EPS) -> Column:
    return eps_div(F.col("fg") + THREE_POINT_BONUS * F.col("p3"), F.col("fga"), eps)


def true_shooting(eps: float = TEAM_EPS) -> Column:
    return F.try_divide(F.col("pts"),
                        F.lit(2.0) * (F.col("fga") + FREE_THROW_WEIGHT * F.col("fta") + F.lit(eps)))


def assist_turnover(eps: float = TEAM_EPS) -> Column:
    return eps_div("ast", "tov", eps)


def efficiency(eps: float = TEAM_EPS) -> dict[str, Column]:
    """Basic efficiency group: true shooting, effective FG, assist/turnover."""
    return {"ts_pct": true_shooting(eps), "efg_pct_f": effective_fg(eps),
            "ast_to_ratio": assist_turnover(eps)}


def four_factors(eps: float = TEAM_EPS) -> dict[str, Column]:
    """Shooting, turnover, offensive-rebound and free-throw-rate factors."""
    poss = F.col("fga") + FREE_THROW_WEIGHT * F.col("fta") + F.col("tov")
    return {
        "efg_factor": effective_fg(eps),
        "tov_factor": F.lit(1.0) - F.try_divide(F.col("tov"), poss + F.lit(eps)),
        "oreb_factor": eps_div("orb", F.col("orb") + F.col("drb"), eps),
        "ftr_factor": eps_div("fta", "fga", eps),
    }


def player_pcts(eps: float = TEAM_EPS) -> dict[str, Column]:
    """Player-aggregated shooting ratios with the epsilon form (``*_p``)."""
    return {
        "fg_pct_p": eps_div("fg", "fga", eps),
        "tp_pct_p": eps_div("p3", "p3a", eps),
        "tp2_pct_p": eps_div("p2", "p2a", eps),
        "ft_pct_p": eps_div("ft", "fta", eps),
        "ts_pct_p": true_shooting(eps),
        "efg_pct_p": effective_fg(eps),
        "ast_to_ratio_p": assist_turnover(eps),
    }


# The measures of the per-36 table.
PER36_MEASURES = ("pts", "ast", "trb", "stl", "blk", "tov", "fga", "fta", "p3a")


def per36(eps: float = PLAYER_EPS, measures=PER36_MEASURES) -> dict[str, Column]:
    """Per-36-minute rates; zero minutes give NULL (not a huge number)."""
    mp = F.nullif(F.col("mp"), F.lit(0.0))
    out = {f"{m}_per36": F.try_divide(F.col(m), mp + F.lit(eps)) * PER_MINUTES for m in measures}
    out["three_point_rate"] = eps_div("p3a", "fga", eps)
    out["free_throw_rate"] = eps_div("fta", "fga", eps)
    out["ast_tov_ratio"] = eps_div("ast", "tov", eps)
    out["usage_proxy"] = F.try_divide(F.col("fga") + FREE_THROW_WEIGHT * F.col("fta"), mp + F.lit(eps))
    return out


def season_label(end_year) -> Column:
    """End year 2005 -> ``"2004-2005"``."""
    y = col_(end_year).cast("int")
    return F.concat_ws("-", (y - 1).cast("string"), y.cast("string"))


def season_start(label) -> Column:
    return F.split_part(col_(label), F.lit("-"), F.lit(1)).try_cast("int")


def season_end(label) -> Column:
    return F.split_part(col_(label), F.lit("-"), F.lit(-1)).try_cast("int")


def overall_score(within1, exact) -> Column:
    return WITHIN1_WEIGHT * col_(within1) + EXACT_WEIGHT * col_(exact)
