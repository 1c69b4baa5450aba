"""Evaluation as grouped aggregates: rank accuracy, regression metrics,
Spearman, classification report, confusion matrix, majority baseline.

Per-period loops of the original become one ``groupBy(period)``; all sums
are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import overall_score
from .rank import rank_many


def pearson(x, y) -> F.Column:
    """Pearson correlation as cov / (sd * sd) with ``try_divide``: a group
    with one row or a constant column gives NULL instead of an ANSI
    divide-by-zero error (``corr`` raises there)."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_ranks(df: DataFrame, truth: str, pred: str, by=(),
               materialize_input: bool = True) -> DataFrame:
    """true_rank / pred_rank (min rank, descending) and their difference;
    both ranks come from one distributed rank pass."""
    r = rank_many(df, [(truth, "true_rank", None), (pred, "pred_rank", None)], by, materialize_input=materialize_input)
    return r.withColumn("rank_diff", F.col("pred_rank") - F.col("true_rank"))


def rank_metrics(ranked: DataFrame, by=()) -> DataFrame:
    """exact / within1 / within2 / overall from a frame with ``rank_diff``; rows without a
    rank take part in none of them, ``n`` included."""
    by = [by] if isinstance(by, str) else list(by)
    d = F.abs(F.col("rank_diff"))
    g = ranked.groupBy(*by) if by else ranked.groupBy()
    out = g.agg(
        F.avg((d == 0).cast("double")).alias("exact"),
        F.avg((d <= 1).cast("double")).alias("within1"),
        F.avg((d <= 2).cast("double")).alias("within2"),
        F.count_if(d <= 1).cast("int").alias("hits_within1"),
        F.count("rank_diff").cast("int").alias("n"))
    return out.withColumn("overall", overall_score("within1", "exact"))


def period_metrics(df: DataFrame, truth: str, pred: str, by: str) -> DataFrame:
    """Every measure per period from one rank pass (min and average ranks together) and
    one ``groupBy``: regression, Pearson, Spearman and rank accuracy."""
    r = rank_many(df, [(truth, "_tr", "_tra"), (pred, "_pr", "_pra")], by)
    y, p = F.col(truth), F.col(pred)
    d = F.abs(F.col("_pr") - F.col("_tr"))
    out = r.groupBy(by).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
        pearson(y, p).alias("pearson"), pearson("_tra", "_pra").alias("spearman"),
        F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within1"),
        F.avg((d <= 2).cast("double")).alias("within2"), F.count(F.lit(1)).cast("int").alias("n"))
    return out.withColumn("overall", overall_score("within1", "exact"))


def reg_metrics(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """MAE, RMSE, R2 (1 - SSE/SST, not squared correlation) and Pearson."""
    by = [by] if isinstance(by, str) else list(by)
    y, p = F.col(truth), F.col(pred)
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        pearson(y, p).alias("pearson"),
        F.count(F.lit(1)).cast("int").alias("n"))
    return out.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


def spearman(df: DataFrame, truth: str, pred: str, by=(), materialize_input: bool = True) -> DataFrame:
    """Spearman = Pearson over average ranks (ties share the mean rank)."""
    by = [by] if isinstance(by, str) else list(by)
    r = rank_many(df, [(truth, "_tr", "_tra"), (pred, "_pr", "_pra")], by, materialize_input=materialize_input)
    g = r.groupBy(*by) if by else r.groupBy()
    return g.agg(pearson("_tra", "_pra").alias("spearman"), F.count(F.lit(1)).cast("int").alias("n"))


def cell_counts(df: DataFrame, label: str, pred: str, classes: list[str]) -> DataFrame:
    """(label, pred, n): one row per cell, every pair of ``classes`` present, zeros
    included.  One ``groupBy``, so at most classes squared rows leave the tasks.
    Labels or predictions outside ``classes`` (NULL included) are an error, not a
    dropped row."""
    spark = df.sparkSession
    seen = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("label")) \
        .withColumn("pred", F.explode(F.array(*map(F.lit, classes))))
    known = F.coalesce(F.col("label").isin(*classes) & F.col("pred").isin(*classes), F.lit(False))
    message = F.concat(F.lit("label or prediction outside the classes: "), F.coalesce("label", F.lit("NULL")),
                       F.lit(" -> "), F.coalesce("pred", F.lit("NULL")))
    checked = seen.withColumn("n", F.when(known, F.col("n")).otherwise(F.raise_error(message).cast("long")))
    return grid.withColumn("n", F.lit(0).cast("long")).unionByName(checked) \
        .groupBy("label", "pred").agg(F.sum("n").alias("n"))


def class_report(df: DataFrame, label: str, pred: str, classes: list[str]) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted averages and
    accuracy, all from the cell counts.  Undefined precision or recall is 0 (the usual
    zero-division default)."""
    cells = cell_counts(df, label, pred, classes)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    by_label = cells.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    per = by_label.join(by_pred, "cls").select(
        "cls", ratio(F.col("tp").cast("double"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp").cast("double"), F.col("support")).alias("recall"), "support", "tp")
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1")
    total = per.agg(
        F.sum("support").cast("long").alias("support"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("acc"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures])
    summary = total.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("cls"), *[F.col(c).alias(m) for c, m in zip(cols, measures)], F.col("support"))
        for name, cols in (("macro avg", [f"macro_{m}" for m in measures]),
                           ("weighted avg", [f"weighted_{m}" for m in measures]), ("accuracy", ["acc"] * 3))])).alias("r"))
    rows = per.select("cls", *measures, F.col("support").cast("long").alias("support"))
    return rows.unionByName(summary.select("r.*"))


def confusion(df: DataFrame, label: str, pred: str, classes: list[str]) -> DataFrame:
    """Confusion matrix with a row and a column for every class, zeros included."""
    cells = cell_counts(df, label, pred, classes)
    return cells.groupBy("label").agg(*[
        F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).cast("long").alias(f"pred_{c}") for c in classes])


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """Most frequent label (ties -> smallest label), as a one-row frame."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("majority"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Accuracy on ``test`` of always predicting the training majority class
    (the majority is a one-row scalar subquery, used in projections only)."""
    maj = majority_class(train, label).scalar()
    hits = test.select((F.col(label) == maj).cast("double").alias("_hit"))
    return hits.agg(F.count(F.lit(1)).alias("n_test"), F.avg("_hit").alias("accuracy")) \
        .select(maj.alias("majority"), "n_test", "accuracy")


def majority_baseline_split(df: DataFrame, label: str, is_train: str) -> DataFrame:
    """Same as ``majority_baseline`` from one frame with a split flag: a
    single pass reduces it to one row per (split, class) before anything else."""
    c = df.groupBy(is_train, label).agg(F.count(F.lit(1)).alias("n"))   # <= 2 x classes rows
    train = c.where(F.col(is_train)).groupBy(label).agg(F.sum("n").alias("n"))
    maj = train.agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))).scalar()
    test = c.where(~F.col(is_train)).select((F.col(label) == maj).cast("double").alias("_hit"), "n")
    return test.agg(F.sum("n").alias("n_test"),
                    F.try_divide(F.sum(F.col("_hit") * F.col("n")), F.sum("n")).alias("accuracy")) \
        .select(maj.alias("majority"), "n_test", "accuracy")
