import numpy as np

from paneltide.operators.knn import knn_regress


def test_blocked_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n, dim, k = 120, 6, 4
    x = rng.normal(size=(n, dim)).astype(np.float32)
    y = rng.integers(0, 5, size=n)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, v array<float>, y int")
    # small cells force many blocks on both sides
    out = {r.q_id: r for r in knn_regress(df, df, k, "id", "v", "id", "v", "y", exclude_self=True,
                                          cell_rows=25).collect()}
    xd = x.astype(np.float64)
    d = np.sqrt(((xd[:, None, :] - xd[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(n):
        nn = np.lexsort((np.arange(n), d[i]))[:k]
        assert abs(out[i].knn_pred - y[nn].mean()) < 1e-12
        assert out[i].nearest_id == nn[0]
        assert out[i].n_neighbors == k


def test_vote_ties_to_smallest(spark):
    # neighbours of id 0 at distances 1,2,3,4 with values 5,3,5,3 -> tie -> 3
    rows = [(0, [0.0], 0), (1, [1.0], 5), (2, [2.0], 3), (3, [3.0], 5), (4, [4.0], 3)]
    df = spark.createDataFrame(rows, "id long, v array<float>, y int")
    r = {x.q_id: x for x in knn_regress(df, df, 4, "id", "v", "id", "v", "y", exclude_self=True).collect()}
    assert r[0].knn_vote == 3.0 and r[0].nearest_id == 1


def test_a_cell_equals_brute_force_with_copies_and_ties():
    import numpy as np
    import pandas as pd
    from paneltide.operators import knn
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 10, (400, 6)) + 1000.0                   # whole numbers: ties are exact, squared norms large
    v[100:160] = v[7]
    side = pd.DataFrame({"id": np.arange(400), "vec": list(v), "value": np.arange(400.0)})
    assert hasattr(knn, "_nearest")                               # one product and a few exact distances, not all differences
    for k, alone in ((5, True), (3, False), (500, True)):
        made = knn._cell_topk(k, alone)(side[["id", "vec"]], side)
        for q in (0, 7, 120, 399):
            d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
            exp = [t for t in np.lexsort((np.arange(400), d)) if not (alone and t == q)][:k]
            assert made[made.q_id == q].t_id.tolist() == exp
