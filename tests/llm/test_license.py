import re

from paneltide.llm import license_diagonal as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "MIT", "mit", "MIT License mit license, MIT", "the Apache-License.", "GENERAL PUBLIC\nLICENSE general public licenses",
    "é mit license", "Released under the the MIT License." * 3, "mit license " * 5000, "Mit LICENSE\x00apache license",
    "x general public license mit license apache license general public license",
]
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def test_base_columns_equal_a_plain_scan(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "mit license")]
    got = L.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, one int")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(
        ((i, *plain(t)) for i, t in rows), key=key)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_notices_add_labels(spark):
    rows = [(1, "Intro text. " + ISC + " end"), (2, "Intro " + ISC.replace("copy,", "copy, or")),
            (3, " ".join(reversed(ISC.split()))), (4, ISC[:40]), (5, (ISC + " ") * 40)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.labels == "isc"} == {1, 2, 5}
    assert got[1].score == 1.0 and got[1].spans[0].start == 2 and got[1].spans[0].end == 2 + len(WORD.findall(ISC.lower()))
    assert 0.6 <= got[2].score < 1 and got[3].score == 0


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_table_of_long_notices(spark):
    import random
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    long, other = words(600), words(300)
    notices = spark.createDataFrame([("long", " ".join(long)), ("long", " ".join(long)), ("other", " ".join(other)), ("short", "a b c"), ("none", None),
                                     (None, " ".join(words(50)))], "label string, text string")
    edited = long[:200] + words(2) + long[200:350] + long[351:]
    docs = [(1, " ".join(words(40) + long + words(40))), (2, " ".join(edited)), (3, " ".join(long[:300])), (4, " ".join(other * 3)), (5, "a b c"),
            (6, " ".join(long[:300] + words(50) + long[:300]))]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string"), notices=notices).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "long", 2: "long", 3: "", 4: "other", 5: "", 6: ""}
    (span,) = got[1].spans
    assert (span.start, span.end, span.coverage) == (40, 640, 1.0)
    assert len(got[4].spans) == 3 and 0.95 < got[2].spans[0].coverage < 1
    empty = L.scan(spark.createDataFrame(docs, "doc_id long, text string"), notices=notices.limit(0)).collect()
    assert {r.labels for r in empty} == {""} and len(empty) == len(docs)


def test_a_place_of_the_notice_counts_once(spark):
    half = " ".join(ISC.split()[:10])                 # the same half twice is not the whole
    got = L.scan(spark.createDataFrame([(1, f"{half} {half}")], "doc_id long, text string")).first()
    assert got.labels == "" and got.score == 0
