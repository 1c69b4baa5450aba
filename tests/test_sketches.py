"""Merged sketches against exact distinct counts."""

import random

from paneltide.operators import sketches as S


def test_estimates_stay_within_the_error_bound(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9000), y) for y in range(2000, 2006) for _ in range(6000)] + [(None, 2000), (None, 1999), (5, None)]
    df = spark.createDataFrame(rows, "player long, year int")
    parts = [S.period_sketches(df.where(f"year % 3 = {k}"), "year", "player") for k in range(3)]
    parts.append(S.period_sketches(df.where("year = 2003"), "year", "player"))        # an arrival counted twice changes nothing
    got = {r.year: r for r in S.distinct_so_far(S.merge_sketches(*parts, period="year"), "year").collect()}
    assert sorted(got) == list(range(2000, 2006))
    seen = set()
    for y in range(2000, 2006):
        own = {p for p, t in rows if t == y and p is not None}
        seen |= own
        for exact, estimate in ((len(own), got[y].n_period), (len(seen), got[y].n_so_far)):
            assert abs(estimate - exact) <= 4 * 0.0163 * exact


def test_empty_table(spark):
    empty = spark.createDataFrame([], "player long, year int")
    assert S.distinct_so_far(S.period_sketches(empty, "year", "player"), "year").collect() == []
