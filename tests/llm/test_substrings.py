import random
import re

import pytest

from paneltide.llm import automaton_dedup as A


def plain(rows, length):
    words = [[w for w in re.split("[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[p:p + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p:p + length])] < i:
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus(rnd, n):
    """Random words with shared passages: whole, shifted, nested, within one text, periodic."""
    word = lambda: rnd.choice("abcdefgh")
    shared = [[word() for _ in range(rnd.randint(3, 25))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice([shared[rnd.randrange(6)][rnd.randint(0, 3):], [word() for _ in range(rnd.randint(1, 12))], ["z"] * rnd.randint(1, 20)])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("length,anchor,shard", [(5, 16, 1024), (8, 3, 1024), (8, 3, 1), (6, 2, 2)])
def test_equals_brute_force(spark, monkeypatch, length, anchor, shard):
    monkeypatch.setattr(A, "ANCHOR", anchor)
    monkeypatch.setattr(A, "SHARD", shard)
    rows = corpus(random.Random(length + shard), 60)
    rows += [rows[3], (4, "another text under the same id a b c d e f g h a b c"), (None, rows[7][1]), (None, None), (99, None), (100, ""), (101, " \t")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = A.dedup(df, length)
    assert got.columns == ["doc_id", "text", "n", "n_words", "n_removed", "kept"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == plain(rows, length)


def test_matching_statistics():
    rnd = random.Random(2)
    for _ in range(50):
        refs = [[rnd.randrange(3) for _ in range(rnd.randint(1, 20))] for _ in range(rnd.randint(1, 4))]
        a = A.SuffixAutomaton()
        for r in refs:
            a.add(r)
        q = [rnd.randrange(4) for _ in range(30)]
        parts = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        exp = [max([0, *(n for n in range(1, e + 2) if tuple(q[e + 1 - n:e + 1]) in parts)]) for e in range(len(q))]
        assert a.matching(q) == exp


def test_empty_table(spark):
    assert A.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_working_names_are_kept(spark):
    rows = [(i, t, 7, [1], "x", 2.5) for i, t in corpus(random.Random(4), 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, marks array<int>, _id string, _th double")
    got = A.dedup(df, 5)
    assert got.columns == ["doc_id", "text", "marks", "_id", "_th", "n_words", "n_removed", "kept"]
    assert {(tuple(r.marks), r._id, r._th) for r in got.collect()} == {((1,), "x", 2.5)}
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == plain([r[:2] for r in rows], 5)
