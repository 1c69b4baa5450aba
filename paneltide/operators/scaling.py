"""Train-fitted imputation and scaling with the semantics of the common
Python preprocessors: population standard deviation, centring on the
median with interpolated quartiles, and min-max with a constant column
mapped to 0.

``fit_*`` runs one aggregate over the training rows and returns a small
parameter dict (two or three numbers per column: a proven size bound, the
same thing a fitted Spark ML model keeps on the driver); ``apply_*`` is a
pure projection, so the holdout never influences the parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import quantiles

SCALERS = ("standard", "robust", "minmax", "none")


def fit_means(train: DataFrame, cols) -> dict:
    row = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def apply_fill(df: DataFrame, means: dict) -> DataFrame:
    """Fill NULLs with the fitted means (a column NULL in all training rows stays NULL)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in means.items()})


def fit_scaler(train: DataFrame, cols, kind: str = "standard", exact: bool = True,
               accuracy: int = 10000) -> dict:
    """Returns ``{col: (center, scale)}``; output = (x - center) / scale."""
    if kind == "none":
        return {c: (0.0, 1.0) for c in cols}
    if kind == "standard":
        aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}__c"), F.stddev_pop(c).alias(f"{c}__s"))]
    elif kind == "minmax":
        aggs = [a for c in cols for a in (F.min(c).alias(f"{c}__c"),
                                          (F.max(c) - F.min(c)).alias(f"{c}__s"))]
    elif kind == "robust":
        if exact:
            found = quantiles(train, cols, [0.25, 0.5, 0.75])
        else:
            row = train.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(c) for c in cols]).first()
            found = {c: row[c] for c in cols}
        return {c: (qs[1], (qs[2] - qs[0]) or 1.0) if qs else (None, 1.0) for c, qs in found.items()}
    else:
        raise ValueError(f"scaler must be one of {SCALERS}")
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        center, scale = row[f"{c}__c"], row[f"{c}__s"]
        if scale is None or scale == 0:
            scale = 1.0          # constant column: centred to 0, not divided by 0
        out[c] = (center, scale)
    return out


def apply_scaler(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(cs[0]).cast("double")) / F.lit(float(cs[1]))
                           for c, cs in params.items()})


def impute_and_scale(train: DataFrame, frames: list[DataFrame], cols, kind: str = "standard"):
    """Fit mean-imputation then the scaler on ``train``; apply to each frame."""
    means = fit_means(train, cols)
    tr = apply_fill(train, means)
    params = fit_scaler(tr, cols, kind)
    return [apply_scaler(apply_fill(f, means), params) for f in frames], means, params
