"""Sketch fingerprints against plain sets of pieces and a plain successor list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paneltide.llm import iblt_fingerprint as B
from paneltide.llm.common import SPACED, utf8, word_hashes, word_spans

SCHEMA = "doc_id long, text string"


def plain_pieces(text: str) -> Counter:
    """The pieces of a text as tuples of words: lines, cut behind words whose hash says so."""
    out = Counter()
    for line in text.split("\n"):
        piece = []
        for w in line.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
            if not w:
                continue
            piece.append(w)
            data, off = utf8(pa.array([w]))
            starts, ends, _ = word_spans(data, off, SPACED)
            if int(word_hashes(data, starts, ends)[0]) % 8 == 0:
                out[tuple(piece)] += 1
                piece = []
        if piece:
            out[tuple(piece)] += 1
    return out


def plain_likeness(a: str, b: str) -> float:
    p, q = plain_pieces(a), plain_pieces(b)
    union = sum((p | q).values())
    return sum((p & q).values()) / union if union else 1.0


def plain(rows):
    """(doc_id, n_chars, edited digest, near_edited, near_next), rows in ascending order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(text, edited), plain_likeness(text, nxt)))
    return out


def same(spark, rows, more=""):
    df = spark.createDataFrame(rows, SCHEMA + more)
    got = B.succeed(df).collect()
    ordered = sorted([r[:2] for r in rows], key=lambda r: (r[0] is not None, r[0] or 0))
    key = lambda r: tuple((x is not None, x) for x in r)
    mine = sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=key)
    assert mine == sorted(plain(ordered), key=key)
    return got


def words(rng, n):
    return "".join(rng.choice(["alpha", "beta", "gamma", "Ünï", "漢字"]) + str(rng.randrange(400)) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def test_equals_plain(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([0, 1, 3, 20, 90, 400]))) for i in rng.sample(range(-100, 2000), 250)]
    rows += [(5000 + i, rows[0][1]) for i in range(60)] + [(6000, words(rng, 30_000)), (6001, "a " * 5000)]
    got = same(spark, rows)
    marks = {}
    for r in got:
        marks.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert all(len(v) == 1 for v in marks.values())
    assert len(marks) == len({t for _, t in rows})


def test_nulls_copies_and_small_tables(spark):
    same(spark, [(3, "one two")])                                      # succeeds itself
    same(spark, [(1, None), (2, ""), (3, "x"), (4, "  \n "), (5, "x")])
    same(spark, [(None, "a b c"), (1, "a b c"), (2, "a b c d e f")])
    rows = [(1, "same words here")] * 7 + [(2, "other words")] * 2 + [(None, "n")] * 3
    same(spark, rows)
    assert B.succeed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_further_columns(spark):
    same(spark, [(i, f"text {i}", i, "x") for i in range(9)], ", part int, copies string")


def test_copies_met_in_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        same(spark, [(1, "hot row")] * 50 + [(0, "first"), (9, "last")])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n", [0, 1, 5, 60, 3000])
def test_peeling_recovers_all_differences(n):
    rng = np.random.default_rng(n)
    shared = rng.integers(0, 2**64, 500, dtype=np.uint64)
    a, b = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n // 2, dtype=np.uint64)
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b]), shared]
    row, keys = np.repeat(np.arange(3), [len(s) for s in sets]), np.concatenate(sets)
    pair, key, sign, cells = B.differences(row, keys, np.array([0, 1, 2]), np.array([1, 2, 2]))
    got = set(zip(pair.tolist(), key.tolist(), sign.tolist()))
    assert got == {(0, k, 1) for k in a.tolist()} | {(0, k, -1) for k in b.tolist()} | {(1, k, 1) for k in b.tolist()}
    assert len(got) == len(pair) and cells[2] == 12 and cells[0] >= n


def test_a_stuck_sketch_is_retried_larger():
    keys = np.arange(1, 400, dtype=np.uint64)
    small = B.Sketches(1, B.BASE)
    small.add(np.zeros(len(keys), np.int64), keys)
    done, *_ = small.peel()
    assert not done[0]
    _, key, _, cells = B.differences(np.zeros(len(keys), np.int64), keys, np.array([0]), np.array([1]))
    assert sorted(key.tolist()) == keys.tolist() and cells[0] > 3 * B.BASE


def test_compare_versions(spark):
    df = spark.createDataFrame([(1, "a b\nc d\ne f", "a b\nx y\ne f", "k"), (2, None, None, "k"), (3, "q", None, None)],
                               "id long, old string, new string, likeness string").select("id", "old", "new")
    got = {r.id: r for r in B.compare(df, ["id"], "old", "new").collect()}
    assert got[1].likeness == plain_likeness("a b\nc d\ne f", "a b\nx y\ne f") and len(got[1].only_old) == len(got[1].only_new) >= 1
    assert got[2].likeness == 1.0 and got[2].fingerprint == got[2].new_fingerprint and got[2].only_old == []
    assert got[3].likeness == 0.0 and len(got[3].only_old) == 1
    assert B.compare(df.limit(0), ["id"], "old", "new").collect() == []
