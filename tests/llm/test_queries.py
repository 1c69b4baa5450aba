"""Registered queries against the SQL that restates them, and the whole pipeline
against brute-force versions of its stages."""

import duckdb
import pytest

from paneltide.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    exp = con.sql(ORACLES[name])
    cols = exp.columns
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(exp.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from test_decontamination import D
    from test_secrets import plain as secrets
    from test_simhash import brute_labels, plain_fingerprint
    import numpy as np
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    assert list(stage) == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]

    known = stage["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    has_letter = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in known.collect()} == has_letter

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    label = brute_labels(np.array([plain_fingerprint(r.text) for r in rows], np.uint64), 2)
    single = stage["near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == {rows[i].doc_id for i in set(label.tolist())}

    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, docs, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if not any(i in norm(r.text) for i in items)}
    assert D.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).columns == docs.columns

    masked = {r.doc_id: r for r in stage["secret_scan"](spark, docs, SF).collect()}
    assert set(masked) == {r.doc_id for r in rows}
    assert all(masked[r.doc_id] == r for r in rows if not secrets(r.text)[1])
    assert any("[SECRET]" in r.text for r in masked.values()) or not any(secrets(r.text)[1] for r in rows)


def test_pipeline_run_and_edge_cases(spark, tmpdir_path):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF)
    assert 0 < out.count() <= docs.count() and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    odd = docs.limit(40).selectExpr("*", "1 as fp", "'x' as _row", "'y' as found", "2.0 as score", "lang as lang_pred")
    odd = odd.unionByName(odd.limit(4)).unionByName(odd.limit(2).selectExpr(
        "cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars", "fp", "_row", "found", "score", "lang_pred"))
    odd.write.parquet(f"{tmpdir_path}/odd")
    odd = spark.read.parquet(f"{tmpdir_path}/odd")
    for name, f in P.STAGES:
        for df in (odd, odd.limit(0)):
            made = f(spark, df, SF)
            assert made.count() <= df.count() and (name == "bpe" or made.columns == df.columns)
