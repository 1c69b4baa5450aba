import pandas as pd

from paneltide.operators import metrics


def _frame(spark):
    rows = [(2000, "A", 0.9, 0.8), (2000, "B", 0.5, 0.5), (2000, "C", 0.5, 0.9), (2000, "D", 0.1, 0.2),
            (2001, "A", 0.7, 0.6), (2001, "B", 0.3, 0.6), (2001, "C", 0.2, 0.1)]
    return spark.createDataFrame(rows, "season_end_year int, team string, win_pct double, pred double"), rows


def test_rank_metric_ordering_and_values(spark):
    df, rows = _frame(spark)
    ranked = metrics.with_ranks(df, "win_pct", "pred", by="season_end_year")
    m = {r.season_end_year: r for r in metrics.rank_metrics(ranked, by="season_end_year").collect()}
    for r in m.values():
        assert r.exact <= r.within1 <= r.within2
        assert abs(r.overall - (0.7 * r.within1 + 0.3 * r.exact)) < 1e-12
    # 2000: true ranks A1 B2 C2 D4, pred ranks C1 A2 B3 D4 -> diffs A+1 B+1 C-1 D0
    assert m[2000].exact == 0.25 and m[2000].within1 == 1.0


def test_regression_metrics_against_pandas(spark):
    df, rows = _frame(spark)
    pdf = pd.DataFrame(rows, columns=["y", "t", "w", "p"])
    out = {r.season_end_year: r for r in metrics.reg_metrics(df, "win_pct", "pred", by="season_end_year").collect()}
    for y, g in pdf.groupby("y"):
        e = g["w"] - g["p"]
        r2 = 1 - (e ** 2).sum() / ((g["w"] - g["w"].mean()) ** 2).sum()
        assert abs(out[y].mae - e.abs().mean()) < 1e-12
        assert abs(out[y].r2 - r2) < 1e-12
        assert abs(out[y].pearson - g["w"].corr(g["p"])) < 1e-12


def test_spearman_uses_average_ranks(spark):
    df, rows = _frame(spark)
    pdf = pd.DataFrame(rows, columns=["y", "t", "w", "p"])
    for _ in range(1):
        out = {r.season_end_year: r.spearman for r in
               metrics.spearman(df, "win_pct", "pred", by="season_end_year").collect()}
        for y, g in pdf.groupby("y"):
            assert abs(out[y] - g["w"].rank().corr(g["p"].rank())) < 1e-12


def test_class_report_zero_division_and_confusion(spark):
    rows = [("Guard", "Guard"), ("Guard", "Big"), ("Wing", "Guard"), ("Big", "Big"), ("Big", "Big")]
    df = spark.createDataFrame(rows, "label string, pred string")
    rep = {r.cls: r for r in metrics.class_report(df, "label", "pred", ["Big", "Guard", "Wing"]).collect()}
    assert rep["Wing"].precision == 0.0 and rep["Wing"].recall == 0.0 and rep["Wing"].f1 == 0.0
    assert rep["accuracy"].precision == 0.6 and rep["accuracy"].support == 5
    assert abs(rep["Big"].precision - 2 / 3) < 1e-12
    cm = {r.label: r for r in metrics.confusion(df, "label", "pred", ["Big", "Guard", "Wing"]).collect()}
    assert cm["Wing"].pred_Wing == 0 and cm["Wing"].pred_Guard == 1
    assert sum(r.pred_Wing for r in cm.values()) == 0


def test_majority_baseline_ties_to_smallest(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "label string")
    test = spark.createDataFrame([("a",), ("a",), ("c",)], "label string")
    r = metrics.majority_baseline(train, test, "label").first()
    assert r.majority == "a" and abs(r.accuracy - 2 / 3) < 1e-12


def test_confusion_has_every_cell_and_refuses_unknown_classes(spark):
    import pytest
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", "C")], "y string, p string")
    got = {r.label: (r.pred_A, r.pred_B, r.pred_C) for r in metrics.confusion(df, "y", "p", ["A", "B", "C"]).collect()}
    assert got == {"A": (1, 1, 1), "B": (0, 0, 0), "C": (0, 0, 0)}
    with pytest.raises(Exception, match="outside the classes"):
        metrics.confusion(df.union(spark.createDataFrame([("A", "Z")], "y string, p string")), "y", "p", ["A", "B", "C"]).collect()
    with pytest.raises(Exception, match="outside the classes"):
        metrics.class_report(df.union(spark.createDataFrame([("A", None)], "y string, p string")), "y", "p", ["A", "B", "C"]).collect()
