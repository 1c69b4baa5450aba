"""Per-period evaluation of scored frames (regression + rank metrics) and
classification scoring helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def period_report(scored: DataFrame, truth: str = "win_pct", pred: str = "pred_score",
                  period: str = "season_end_year") -> DataFrame:
    """MAE, RMSE, R2, Pearson, Spearman, exact / within1 / within2 / overall
    per period, from one rank pass and one aggregate."""
    return metrics.period_metrics(scored.select(period, truth, pred), truth, pred, period)


def detailed_predictions(scored: DataFrame, truth: str = "win_pct", pred: str = "pred_score",
                         period: str = "season_end_year") -> DataFrame:
    """Rows with true_rank, pred_rank and rank_diff, ordered by (period,
    predicted rank).  A range-partitioned sort: a large period spreads over
    several tasks instead of landing in one."""
    r = metrics.with_ranks(scored, truth, pred, by=period)
    return r.orderBy(period, "pred_rank", "true_rank")


def binary_report(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    s = scored.select(F.col(label).cast("int").cast("string").alias("y"),
                      F.col(pred).cast("int").cast("string").alias("p"))
    return metrics.class_report(s, "y", "p", ["0", "1"])
