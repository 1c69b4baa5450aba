import random

import pytest
from tokenizers import Tokenizer

from paneltide.llm import rank_bpe as R
from paneltide.llm.queries import vocabulary_path

TEXTS = [
    "", " \n", "a<|endoftext|>b <|startoftext|>", "<|STARTOFTEXT|> <|endof text|>", "ΑΣ ΣΑΣ İstanbul ẞ é é \x1c a\x1db \x85 　x 12³ ½",
    "it's I'LL don't DON'T 'twas", "x" * 700 + " " + "!" * 500 + " " + "ab" * 400, "\x00\x01 ﻿​", "日本語テキスト 한국어 😀😀 Ⅷ ٣", "Éléphant, über; naïve—test",
]


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    return Tokenizer.from_file(path), R.RankBpe(open(path, encoding="utf-8").read())


def test_ids_and_texts_equal_the_library(both):
    lib, own = both
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("abcdeéß '!.0 \n") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    ids = own.encode_many(texts)
    for t, got, exp in zip(texts, ids, lib.encode_batch(texts, add_special_tokens=False)):
        assert got == exp.ids, t
        assert own.decode(got) == lib.decode(got, skip_special_tokens=False)


def test_short_and_long_words_merge_alike(both):
    _, own = both
    rnd = random.Random(8)
    for n in (1, 2, 3, 20, 90, 96):
        word = bytes(rnd.choice(b"abcdehinorst") for _ in range(n))
        assert list(own._merge_group([word])[0]) == own._merge_long([*(own.inner[b] for b in word[:-1]), own.last[word[-1]]])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello World", "z"), (3, "Hello World", "z"), (None, "w " * 60000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = R.encode_decode(df, vocabulary_path())
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].ids == [] and by[1].decoded == "" and by[2].ids == [] and len(by[None].ids) == 60000
    assert by[3].decoded == "hello</w> world</w>" and got.count() == 5
    assert R.encode_decode(df.limit(0), vocabulary_path()).count() == 0


def test_cache_is_emptied(both, monkeypatch):
    lib, own = both
    monkeypatch.setattr(R, "CACHE", 5)
    for t in ("one two three four five six seven", "eight nine one two"):
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
