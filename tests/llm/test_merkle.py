"""Merkle manifest against a plain tree: all rows in one process, sorted by source and id."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paneltide.llm import merkle_bitmap as M
from paneltide.llm.queries import op12_columns

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def record(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) for every row."""
    def climb(hashes):
        """the root, and for each leaf its [(left, right)]"""
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for i in range(len(paths)):
                run = at[i] // 16
                kids = level[run * 16:run * 16 + 16]
                paths[i].append(("".join(kids[:at[i] % 16]), "".join(kids[at[i] % 16 + 1:])))
            level = [sha("".join(level[k:k + 16])) for k in range(0, len(level), 16)]
            at = [a // 16 for a in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    done = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        g = [(r, record((r[0], r[1], r[2], r[3], r[4]))) for r in groups[source]]
        g.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        done.append((g, *climb([leaf for _, leaf in g])))
    root, tops = climb([sub for _, sub, _ in done])
    out = []
    for (g, sub, paths), top in zip(done, tops):
        for (r, leaf), path in zip(g, paths):
            path = path + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = record((*r[:4], text))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def same(spark, rows, schema=SCHEMA):
    got = [tuple(r) for r in op12_columns(spark.createDataFrame(rows, schema)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain([r[:5] for r in rows]), key=key)


def test_equals_plain_tree(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-300, 5000), 900)
    same(spark, [(i, rng.choice(["b", "a", "é", "Z", None]) if k % 3 else "hot", "en", 7, f"Text {i} " * rng.randrange(4)) for k, i in enumerate(ids)])


def test_nulls_repeats_long_texts_and_wide_ids(spark):
    rows = [(5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "B"), (6, "s", None, None, None), (6, "s", None, None, ""),
            (None, "s", "en", 3, "x"), (None, "s", "en", 3, "y"), (None, None, None, None, None), (-(2**63), "s", "en", 1, "Q"),
            (2**63 - 1, "s", "en", 1, "Ä😀"), (2**40, "", "en", 1, ""), (7, "s", "en", 9, "Long Text " * 50_000)]
    rows += [(11, "copies", "en", 1, "Same")] * 40 + [(None, "copies", "en", 1, f"t{i}") for i in range(30)]
    same(spark, rows)
    same(spark, rows[:1])                      # one leaf is the root; no sibling


def test_many_sources(spark):
    same(spark, [(i, f"src{i}", "en", 1, "T") for i in range(300)])


def test_sparse_ids_climb_the_directory(spark):
    rng = random.Random(5)
    same(spark, [(rng.randrange(-(2**62), 2**62), "s", "en", 1, "T") for _ in range(200)])


def test_empty_table_and_further_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", slot int, key string")
    assert op12_columns(df).collect() == []
    same(spark, [(i, "s", "en", 1, "Tx", 1, "k") for i in range(20)], SCHEMA + ", slot int, key string")


@pytest.mark.parametrize("span", [3, 4096, 4097])
def test_directory_counts_smaller_cells(spark, span):
    cells = spark.createDataFrame([("k", c, c % 3 + 1) for c in (0, 1, span - 1, span)] + [("k", None, 2)], "key string, cell long, rows long").groupBy(
        "key", "cell").agg(F.sum("rows").alias("rows"))
    rows = {r.cell: r.rows for r in cells.collect()}
    got = {r.cell: r.before for r in M.directory(cells, 0, span).collect()}
    order = [None, *sorted(c for c in rows if c is not None)]
    assert got == {c: sum(rows[d] for d in order[:i]) for i, c in enumerate(order)}
