"""License notices by diagonal voting.

Every rolling word k-gram of every document is hashed and joined, in Spark, with
the k-grams of license notices: a table (label, text) of notices of any number and length, or
the fixed ``NOTICES`` (a few hundred k-grams, so their broadcast has a fixed size).  A hit votes for the diagonal ``document position -
notice position``; votes are counted per document, notice and diagonal, neighbouring
diagonals (words inserted or left out) are merged, and a span is verified: every vote must
also agree on a second, independent 64-bit hash, and the span must hold ``COVERAGE``
of the notice's k-grams, each counted once over its diagonals.

Words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.
Phrases that name a license (``PHRASES``) are found word by word; the notices add to the
labels and never take one away.

Edge cases: null text is empty: no words, no labels, score 0; texts shorter than k
words have phrases only; a phrase or notice that repeats counts at every place;
repeated rows give repeated results; an empty table gives no rows; further
columns are ignored; notices with a null text or label, or of fewer than k words, are never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ALNUM, ascii_lower, gram_hashes, slices, utf8, within_rows, word_hashes, word_spans

#: words per k-gram; diagonals this near are one span; share of a notice's k-grams that a span holds
K = 4
NEAR = 3
COVERAGE = 0.6

#: phrases and labels, fixed by the contract
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: opening sentences of public license notices, by label
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


class _Words:
    """Words of the rows of a batch and their two hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        data = ascii_lower(data)
        starts, ends, self.first = word_spans(data, offsets, LOWER_ALNUM)
        self.one = word_hashes(data, starts, ends, 1)
        self.two = word_hashes(data, starts, ends, 2)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, second hash, row) of all k-grams that stay in their row."""
        ok = within_rows(self.first, k)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:len(ok)]
        return gram_hashes(self.one, k)[ok], gram_hashes(self.two, k)[ok], row[ok]

    def places(self, phrase: np.ndarray) -> np.ndarray:
        """Indexes of words at which the phrase's words stand consecutively."""
        k = len(phrase)
        hit = within_rows(self.first, k)
        for j, h in enumerate(phrase):
            hit = hit & (self.one[j:j + len(hit)] == h)
        return np.flatnonzero(hit)


def _scan(key: str, k: int):
    phrases = [(_Words(pa.array([p])).one, label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, n = _Words(part.column("text")), part.num_rows
                at = [w.places(p) for p, _ in phrases]
                every = np.sort(np.concatenate(at))
                row = np.searchsorted(w.first, every, "right") - 1
                place = every - w.first[row]
                count = np.bincount(row, minlength=n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, row, place)
                np.maximum.at(high, row, place)
                labels: list[set] = [set() for _ in range(n)]
                for places, (_, label) in zip(at, phrases):
                    for r in np.unique(np.searchsorted(w.first, places, "right") - 1):
                        labels[r].add(label)
                one, two, of = w.grams(k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["one", "two"]))
                none = count == 0
                yield pa.RecordBatch.from_arrays([
                    part.column("_row"), part.column(key), pa.array(np.diff(w.first)), pa.array(count),
                    pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())), grams,
                ], ["_row", key, "n_words", "n_base", "first_word", "last_word", "base", "grams"])
    return run


TEMPLATES = "one long, two long, notice long, label string, at int, size int"


def templates(notices: DataFrame, k: int = K) -> DataFrame:
    """(one, two, notice, label, at, size): every k-gram of every notice (label, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                one, two, row = _Words(part.column("text")).grams(k)
                size = np.bincount(row, minlength=part.num_rows)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column("notice").take(of), part.column("label").take(of),
                     pa.array(at.astype(np.int32)), pa.array(size[row].astype(np.int32))], [f.split()[0] for f in TEMPLATES.split(", ")])

    rows = notices.where("label IS NOT NULL").select("label", "text").distinct().withColumn("notice", F.xxhash64("label", "text"))
    return rows.mapInArrow(run, TEMPLATES)


def scan(docs: DataFrame, key: str = "doc_id", k: int = K, notices: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: counts and places of phrases, labels, score, and
    ``spans`` (label, start, end, coverage) of the verified notices (a table of label and text;
    ``NOTICES`` if none is given)."""
    if notices is None:
        known_grams = F.broadcast(templates(docs.sparkSession.createDataFrame(NOTICES, "label string, text string").coalesce(1), k))
    else:
        known_grams = templates(notices, k)             # of any size: the join is planned from it
    schema = T.StructType([T.StructField("_row", T.LongType()), docs.schema[key]])
    for name in ("n_words", "n_base", "first_word", "last_word"):
        schema.add(name, T.LongType())
    schema.add("base", T.ArrayType(T.StringType()))
    schema.add("grams", T.ArrayType(T.StructType().add("one", T.LongType()).add("two", T.LongType())))
    read = docs.select(key, "text").withColumn("_row", F.monotonically_increasing_id())
    known = read.mapInArrow(_scan(key, k), schema)
    facts = F.struct(key, "n_words", "n_base", "first_word", "last_word", "base").alias("facts")
    # one row without a k-gram keeps each document; the rest are its rolling k-grams
    grams = known.select("_row", facts, F.posexplode_outer("grams").alias("pos", "g"))
    grams = grams.select("_row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("facts")).alias("facts"), "pos", F.col("g.one").alias("one"), F.col("g.two").alias("second"))
    hits = (grams.join(known_grams, "one", "left")
            .withColumn("notice", F.when(F.col("two") == F.col("second"), F.col("notice")))
            .where("facts IS NOT NULL OR notice IS NOT NULL")
            .withColumn("diagonal", F.when(F.col("notice").isNotNull(), F.col("pos") - F.col("at"))))
    votes = (hits.repartition("_row").groupBy("_row", "notice", "diagonal")
             .agg(F.first("facts", ignorenulls=True).alias("facts"), F.first("label").alias("label"), F.first("size").alias("size"),
                  F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.collect_set("at").alias("votes")))
    line = Window.partitionBy("_row", "notice").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(line) > NEAR)
    spans = (votes.withColumn("span", F.sum(F.when(far, 1).otherwise(0)).over(line))
             .groupBy("_row", "notice", "span")
             .agg(F.first("facts", ignorenulls=True).alias("facts"), F.first("label").alias("label"),
                  F.min("start").alias("start"), F.max("end").alias("end"),
                  (F.size(F.array_distinct(F.flatten(F.collect_list("votes")))) / F.first("size")).alias("coverage")))
    sure = F.when((F.col("coverage") >= COVERAGE) & F.col("notice").isNotNull(), F.struct("label", "start", "end", "coverage"))
    out = spans.groupBy("_row").agg(F.first("facts", ignorenulls=True).alias("facts"), F.array_sort(F.collect_list(sure)).alias("spans"))
    labels = F.array_sort(F.array_union("facts.base", F.transform("spans", lambda s: s["label"])))
    best = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return out.select(
        f"facts.{key}", "facts.n_words", "facts.n_base", "facts.first_word", "facts.last_word",
        F.array_join("facts.base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("facts.n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "spans")
