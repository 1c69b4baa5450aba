from paneltide.functions import labels as L


def test_label_text_cases(spark):
    vals = [None, "", "as", "MVP-10", "DPOY-4", "all-nba", "AS,NBA1"]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    r = df.select(L.contains_ci("a", "AS").alias("star"), L.contains_any_ci("a").alias("award")).collect()
    assert [x.star for x in r] == [0, 0, 1, 0, 0, 0, 1]
    assert [x.award for x in r] == [0, 0, 0, 1, 0, 1, 1]


def test_position_maps(spark):
    vals = [" pg ", "SF-PF", "G-F", "", None, "c", "PF"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    r = df.select(L.position_five("p").alias("p5"), L.position_three("p").alias("p3")).collect()
    assert [x.p5 for x in r] == ["PG", "SF", None, None, None, "C", "PF"]
    assert [x.p3 for x in r] == ["Guard", "Wing", None, None, None, "Big", "Big"]
