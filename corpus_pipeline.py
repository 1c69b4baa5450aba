"""Corpus pipeline: documents to token ids in five stages.

Each stage calls one operator of ``paneltide.llm`` on all rows that the stage before
it kept, returns a DataFrame that is written as Parquet, and the next stage reads
that.  All but the last return the columns of ``documents``.

1. language ID: rows that no learnt language explains, and rows without a letter, go.
2. near-dedup: of every SimHash component (3-word shingles, 2 bits) the row of the
   smallest doc_id stays.
3. decontamination: rows that leak a benchmark item go.
4. secrets: owner-specific, live-looking values are replaced in the texts; no row goes.
5. BPE: texts become token ids, with digests of the ids and of the decoded text.

Edge cases are those of the operators: null and empty texts have no letter and go in
stage 1; repeated rows are copies and go in stage 2; an empty table passes through
all stages as an empty table; further columns are carried along until stage 5.

Stage 1 learns from a model and SQL can express neither it nor the SimHash
fingerprints, so there is no ``ORACLE_SQL``; tests compare the stages with
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import kn_langid, rank_bpe, secret_ownership, simhash_bk, template_decon
from paneltide.llm.queries import vocabulary_path
from paneltide.session import scratch_path, scratch_scope
from paneltide.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kn_langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.keep_first(docs, radius=2, k=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decon.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ownership.redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = rank_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    digests = rank_bpe.digest_columns()
    return coded.select("doc_id", "lang", "source", "ids", *digests)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):  # what a stage stages goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
