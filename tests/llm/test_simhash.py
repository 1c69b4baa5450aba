import random

import numpy as np
import pytest
import xxhash

from paneltide.llm import simhash_bk as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(fps, radius):
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(n)
    while True:
        new = np.array([label[near[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def clusters(rnd, n):
    """Fingerprints in tight and loose groups, chains included."""
    out = []
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            out.append(x)
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
    return out[:n]


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "one two", "A b C d", "É é\x1c x\x0by z", "a b c " * 500, "x" * 5000, " wide space stays"])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_trees_find_every_link():
    rnd = random.Random(1)
    for seed in range(20):
        rnd.seed(seed)
        fps = np.unique(np.array(clusters(rnd, 300), np.uint64))
        label = S.linked(fps, np.zeros(len(fps), np.int64), 2)
        assert (label == brute_labels(fps, 2)).all()


def test_tree_children_are_keyed_by_distance():
    fps = np.unique(np.array(clusters(random.Random(3), 200), np.uint64))
    roots, edge, child = S.bk_trees(fps, np.zeros(len(fps), np.int64))
    assert roots.tolist() == [0] and len(np.unique(edge)) == len(edge) == len(fps) - 1
    assert (np.bitwise_count(fps[edge // 65] ^ fps[child]) == edge % 65).all()


@pytest.mark.parametrize("shard", [2048, 3])  # 3: shards are cut a second time
def test_components_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    fps = np.unique(np.array(clusters(random.Random(5), 400), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.label for r in S.connected(S.links(df, 2)).collect()}
    label = brute_labels(fps, 2)
    ids = fps.view(np.int64).tolist()
    groups = {}
    for i, l in enumerate(label):
        groups.setdefault(l, set()).add(ids[i])
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(n for n, l in got.items() if l == x) for x in set(got.values())}


def test_long_path_is_one_component(spark):
    nodes = list(range(200))
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    assert len({r.label for r in S.connected(edges).collect()}) == 1


ROWS = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"),
        (4, "one two three four five six seven"), (None, "one two three four five six seven"), (None, "quite another text of its own here"),
        (9, "x " * 30000)]


def test_edge_cases(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in S.components(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (None, 3), (None, None), (9, 9)], key=str)
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=str) == sorted(
        [(1, ""), (3, "one t"), (None, "quite"), (9, "x x x")], key=str)
    assert S.components(df.limit(0)).count() == 0 and S.keep_first(df.limit(0)).count() == 0
