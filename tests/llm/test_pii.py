import hashlib
import re

from pyspark.sql import functions as F

from paneltide.llm import pii_boost as P


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def plain(text):
    counts, spans = [], []
    for kind, regex, ok in RULES:
        found = [m for m in re.finditer(regex, text or "") if ok(m)]
        counts.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


TEXTS = [
    None, "", "é😀 a.b@c.d_e@f.gh x@y @z.q a@b..c a@b.c.d. a@b.c@d.e", "x" * 3000 + "@" + "y" * 3000 + ".z" * 2000,
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 1.2.3 " + "7" * 50 + ".1.1.1", "4111 1111-1111 1111 12345678901234567890123",
    "+1 (743) 555-3824+49 30 1234567 +1 +12 3- +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 40 + " 4111111111111111 " * 600, "12 34 " * 3000,
    "call +1 (743) 555-3824 or (743) 555-3825, mail me at joe [at] example [dot] com",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, TEXTS[5])]
    got = P.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()
    exp = sorted((str(i), *plain(t)[0]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == exp
    for r in got:
        text = dict((str(i), t) for i, t in rows)[str(r.doc_id)]
        assert set(plain(text)[1]) <= set(r.spans.split(",")) | {""}


def corpus(spark, n=400):
    """Numbers called phones in one context, orders in another."""
    good = "concat('please call +1 (', 200 + id % 700, ') 555-', 1000 + id % 9000, ' today')"
    bad = "concat('order no ', 10 + id % 80, '-', 100 + id % 900, '.', 1000 + id % 8000, ' ref ', id)"
    return spark.range(n).selectExpr("id as doc_id", f"if(id % 2 = 0, {good}, {bad}) as text")


def test_trees_as_sql_equal_the_model_and_add_spans(spark):
    docs = corpus(spark)
    extra = spark.createDataFrame([(10_001, "please call (312) 555-7788 today")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.scan(docs.union(extra)).collect()}
    assert got[10_001].n_phone == 0 and got[10_001].n_added == 1 and got[10_001].spans.startswith("phone:")
    assert not any(r.n_added for i, r in got.items() if i % 2 == 1 and i != 10_001)

    found = P.findings(docs, ["doc_id"])
    margin, limits = P.train(found)
    assert set(limits) <= {0, 1, 2, 3}
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rows = found.select(F.explode("candidates").alias("c")).selectExpr("c.features f", "double(c.personal) label")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=4, maxDepth=3, stepSize=0.3, seed=7).fit(rows.withColumn("x", array_to_vector("f")))
    sql = " + ".join(f"{w}D * ({P._tree_sql(t.toDebugString)})" for w, t in zip(model.treeWeights, model.trees))
    both = model.transform(rows.withColumn("x", array_to_vector("f"))).select(
        vector_to_array("rawPrediction")[1].alias("a"), F.expr(sql).alias("b")).distinct().collect()
    assert both and all(abs(r.a / 2 - r.b) < 1e-9 or abs(r.a - 2 * r.b) < 1e-9 or abs(r.a - r.b) < 1e-9 for r in both)


def test_common_local_forms_are_added(spark):
    """Local phone numbers and spelled-out emails that are far more common than strict ones."""
    local = "concat('please call (', 200 + id % 700, ') 555-', 1000 + id % 9000, ' today')"
    bare = "concat('it was (', 200 + id % 700, ') 555-', 1000 + id % 9000, ' then')"
    spelled = "concat('mail joe', id, ' [at] example [dot] com now')"
    site = "concat('see page at site', id, '.org')"
    docs = corpus(spark).union(spark.range(1000, 4000).selectExpr("id as doc_id", f"CASE id % 4 WHEN 0 THEN {local} WHEN 1 THEN {bare} WHEN 2 THEN {spelled} ELSE {site} END"))
    got = P.scan(docs).where("doc_id >= 1000").collect()
    assert all((r.n_added, r.spans.split(":")[0]) == (1, "email" if r.doc_id % 4 == 2 else "phone") for r in got if r.doc_id % 4 < 3)
    assert not any(r.n_added for r in got if r.doc_id % 4 == 3)


def test_a_rare_kind_is_calibrated_on_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(P, "TRAIN_ROWS", 200)
    mail = "if(id % 2 = 0, concat('mail joe', id, ' [at] example [dot] com now'), concat('see page at site', id, '.org'))"
    docs = corpus(spark, 4000).union(spark.range(10_000, 10_300).selectExpr("id as doc_id", mail))
    assert set(P.train(P.findings(docs, ["doc_id"]))[1]) == {0, 3}


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "plain words alone"), (2, "3 4")], "doc_id long, text string")
    assert {(r.spans, r.n_added) for r in P.scan(df).collect()} == {("", 0)}
    assert P.scan(df.limit(0)).count() == 0
