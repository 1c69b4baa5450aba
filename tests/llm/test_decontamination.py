from paneltide.llm import template_decon as D

ITEM = "Today Tom buys 5 red apples for 3 dollars. Later that day Tom eats 5 of them and is happy."


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, sorted(((r[0], r[1], r.kind) for r in D.leaks(d.select("doc_id", "text"), b, ["doc_id"]).collect()), key=str)


def test_kinds_of_leaks(spark):
    docs = [
        (1, "Before it all. " + ITEM + " And after."),
        (2, "before TODAY TOM BUYS 5 RED APPLES for 3 dollars later that day tom eats 5 of them, and is happy"),
        (3, ITEM.replace("Tom", "Maria").replace("5", "70").replace("dollars", "euros")),
        (4, ITEM.replace("Later that day Tom", "Later that day Maria")),   # one name, two values
        (5, ITEM.replace("eats 5", "eats 9")),                              # one number, two values
        (6, "5 3 7 9 1 2 5 3 8 8 8 1 2 3 4 5 6 7"),
        (7, "today is another day and nobody buys apples for dollars"),
    ]
    d, b, got = run(spark, docs, [(10, ITEM)])
    assert got == [(1, 10, "exact"), (2, 10, "exact"), (3, 10, "reparameterised")]
    assert sorted(r.doc_id for r in D.clean(d, b).collect()) == [4, 5, 6, 7]
    assert D.clean(d, b).columns == d.columns


def test_slots_are_checked_by_run(spark):
    item = "Ann packs 5 red boxes with 3 old books for the school and then she walks home slowly because Ann carried 5 heavy bags up the hill"
    docs = [(1, item.replace("she walks", "he runs").replace("carried 5", "carried 9")),  # two runs, each consistent
            (2, item.replace("5", "4").replace("3", "4")), (3, item.replace("carried 5", "carried 9"))]
    assert run(spark, docs, [(10, item)])[2] == [(1, 10, "reparameterised"), (2, 10, "reparameterised")]


def test_short_and_number_dense_items_are_found(spark):
    items = [(1, "What is 15 times 12?"), (2, "Factor 36 into primes"), (3, "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg and 9 kg")]
    docs = [(i, "Here it comes. " + t + " So it went.") for i, t in items] + [(4, "What is 16 times 12?"), (5, "Factor 35 into primes")]
    assert run(spark, docs, items)[2] == [(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact")]


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, "Short item here"), (4, ITEM * 2000), (4, ITEM * 2000), (5, "été ÉTÉ Œuvre fin")]
    items = [(1, None), (2, ""), (3, "short item here"), (10, ITEM), (10, ITEM), (11, "ÉTÉ été œuvre fin")]
    d, b, got = run(spark, docs, items)
    assert got == sorted([(None, 3, "exact"), (4, 10, "exact"), (4, 10, "exact"), (5, 11, "exact")], key=str)
    assert D.leaks(d.limit(0), b, ["doc_id"]).count() == 0
    assert D.leaks(d, b.limit(0), ["doc_id"]).count() == 0 and D.clean(d, b.limit(0)).count() == len(docs)


def test_blocks_give_the_same_leaks(spark, monkeypatch):
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta eta theta iota kappa{i} lambda mu") for i in range(7)]
    docs = [(i, "so " + t + " it is") for i, t in items]
    one = run(spark, docs, items)[2]
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert len(list(D._blocks(spark.createDataFrame(items, "item_id long, text string")))) == 7
    assert run(spark, docs, items)[2] == one and {(i, i) for i in range(7)} <= {g[:2] for g in one}


def test_whole_items_are_found(spark):
    """Against a plain search for whole items among lower-case words."""
    import re
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    exp = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench, ["doc_id"]).collect()} == exp


def test_ids_of_any_type(spark):
    d = spark.createDataFrame([("d1", "so " + ITEM), ("d2", "nothing here")], "doc_id string, text string")
    b = spark.createDataFrame([("item-7", ITEM), (None, "another item of a few words")], "item_id string, text string")
    got = D.leaks(d, b, ["doc_id"])
    assert got.schema["item_id"].dataType.simpleString() == "string"
    assert [tuple(r)[:2] for r in got.collect()] == [("d1", "item-7")]
    assert [r.doc_id for r in D.clean(d, b).collect()] == ["d2"]
