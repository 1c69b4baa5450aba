import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import kn_langid as K


def model(texts):
    key, _, _, _ = K.grams(texts)
    k, c = np.unique(key, return_counts=True)
    return K.KneserNey(k, c, (c == 1).sum(), (c == 2).sum())


def test_probabilities_of_a_context_sum_to_one():
    m = model(["the cat sat on the mat", "a hat for the cat", "that is that"])
    chars = m.orders[0][0]  # all characters that occur
    for ctx in ("the", "at ", "zzz", " th"):
        pre = sum(int(ord(c)) << 16 * (3 - i) for i, c in enumerate(ctx))
        total = np.exp(m.log_prob(np.uint64(pre) + chars)).sum()
        assert total == pytest.approx(1, abs=2e-2) and total <= 1 + 1e-9


def test_grams_do_not_depend_on_neighbours():
    texts = ["Hello, World!", None, "", "12 3", "é", "a  b\n\nc"]
    key, row, letters, head = K.grams(texts)
    for i, t in enumerate(texts):
        alone = K.grams([t])
        assert (key[row == i] == alone[0]).all() and letters[i] == alone[2][0]
    assert letters.tolist() == [10, 0, 0, 0, 1, 3] and set(head.tolist()) <= set(range(len(key)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = K.identify(docs, ["doc_id", "lang"]).where("held_out AND lang IS NOT NULL").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert not got.rejected.any()          # ordinary documents stay
    odd = docs.select("lang").limit(1).selectExpr("999990L doc_id", "repeat('qzxj wvkq zzxq ', 40) text", "lang")
    both = K.identify(docs.select("doc_id", "text", "lang").union(odd), ["doc_id"]).where("rejected").collect()
    assert [r.doc_id for r in both] == [999990]   # no language explains it


def test_junk_in_the_calibration_fold_sets_no_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.range(900_000, 900_100).selectExpr("id as doc_id", "repeat('qzxj wvkq zzxq ', 40) text").where(K.fold() == K.CALIBRATION).limit(1)
    lang = K.identify(docs.unionByName(junk.selectExpr("*", "'en' lang")), ["doc_id"]).where("doc_id >= 900000").first().lang_pred
    both = docs.unionByName(junk.withColumn("lang", F.lit(lang)))  # labelled as it is predicted
    odd = spark.createDataFrame([(999_990, "xqkz vjqw qqzx " * 40, "en")], docs.schema)
    got = K.identify(both.unionByName(odd), ["doc_id"]).where("rejected").collect()
    assert {r.doc_id for r in got} == {junk.first().doc_id, 999_990}


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !!", None), (None, "the the", "en"), (4, "die die", "de"), (4, "die die", "de"),
            (5, "wort " * 20000, "de"), (6, "the thing", "en"), (7, "und die", None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = K.identify(df.drop("score", "lang_pred"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.letters == 0) == [(1, "und"), (2, "und"), (3, "und")]
    assert all(r.rejected and r.score == 0 for r in got if r.letters == 0) and len(got) == len(rows)
    assert K.keep_known(df).columns == df.columns
    assert K.identify(df.limit(0), ["doc_id"]).count() == 0 and K.keep_known(df.limit(0)).count() == 0
    unlabelled = K.identify(df.select("doc_id", "text").selectExpr("*", "cast(null as string) lang"), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)} and sum(r.rejected for r in unlabelled) == 3


def brute(texts, order=4):
    """Interpolated Kneser-Ney of one language from dictionaries: log p(last character of a gram)."""
    key, *_ = K.grams(texts)
    c = [{}]
    for k in key.tolist():
        c[0][k] = c[0].get(k, 0) + 1
    for bits in (48, 32, 16):
        c.append({})
        for k in c[-2]:
            c[-1][k & 2**bits - 1] = c[-1].get(k & 2**bits - 1, 0) + 1
    c = c[::-1]
    d = [K._discount(sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())) for t in c]

    def p(k, n):
        if n == 0:
            return d[0] / sum(c[0].values())
        if n == 1:
            seen = c[0].get(k & 0xFFFF)
            return p(k, 0) if seen is None else max(seen - d[0], 0) / sum(c[0].values()) + p(k, 0)
        k &= 2 ** (16 * n) - 1
        same = [v for x, v in c[n - 1].items() if x >> 16 == k >> 16]
        if not same:
            return p(k, n - 1)
        return max(c[n - 1].get(k, 0) - d[n - 1], 0) / sum(same) * (k in c[n - 1]) + d[n - 1] * len(same) / sum(same) * p(k, n - 1)

    return lambda k: np.log(p(k, order))


def test_tables_equal_a_brute_force_model(spark):
    texts = {"en": ["the cat sat on the mat", "a hat for the cat, that is that", "\u4e2d\u6587 x"], "de": ["die katze sitzt auf der matte", "das ist das"]}
    rows = [(i, t, lang, False) for lang, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame([*rows, (9, None, "en", False), (9, "zzz", "de", True)], "doc_id long, text string, lang string, later boolean")
    counts = K.counted(df, F.col("later"))
    models = K.train(counts, "first").fetch(["de", "en"])
    for lang, ts in texts.items():
        exp = brute(ts)
        asked = np.concatenate([K.grams(["the matte zz the chat katz q \u4e2d"])[0], K.grams(ts)[0]])
        assert np.allclose(models[lang].log_prob(asked), [exp(k) for k in asked.tolist()])
        assert np.allclose(model(ts).log_prob(asked), models[lang].log_prob(asked))
    both = K.train(counts, "both").fetch(["de"])["de"]
    assert np.allclose(both.log_prob(asked), [brute([*texts["de"], "zzz"])(k) for k in asked.tolist()])


def test_groups_of_languages_give_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.limit(1).selectExpr("-1L doc_id", "cast(null as string) text", "lang")).unionByName(docs.limit(1).selectExpr("-2L doc_id", "'' text", "lang"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9), round(r.entropy, 9), r.chars, r.rejected) for r in df.collect())
    one = key(K.identify(docs, ["doc_id"]))
    monkeypatch.setattr(K, "GROUP_BYTES", 1)                       # a group for each language
    assert key(K.identify(docs, ["doc_id"])) == one
