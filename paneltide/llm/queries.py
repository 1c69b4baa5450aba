"""Queries of the training-data operators and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.sources.tables import read_table

from . import automaton_dedup, chebyshev_whiten, iblt_fingerprint, kn_langid, license_diagonal, merkle_bitmap, nra_topk, pii_boost, prefix_chat, rank_bpe, secret_ownership, simhash_bk, template_decon

#: file of the public vocabulary; any path the driver can read
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash component of every document (3-word shingles, 2 bits)."""
    return simhash_bk.components(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), radius=2, k=3)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak: one row per document and item."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return template_decon.leaks(docs, read_table(spark, sf_dir, "benchmark"), ["doc_id"])


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return license_diagonal.scan(docs).withColumn("spans", F.col("spans").cast("string"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document of smaller id holds."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return automaton_dedup.dedup(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside fold 0."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return kn_langid.identify(docs, ["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy", "chars")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii_boost.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document is a repository, its source the owner."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return secret_ownership.scan(docs)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return rank_bpe.encode_decode(docs, vocabulary_path()).select("doc_id", *rank_bpe.digest_columns())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector, against all others."""
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return nra_topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of every conversation, read back as digests."""
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                 "conv_id long, turn long, role string, text string")
    return prefix_chat.read_back(prefix_chat.examples(rows.unionByName(more)), in_order=True)


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, and their likeness by peeling."""
    made = iblt_fingerprint.succeed(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells")


def op12_columns(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against texts that were tampered with: every fifth
    document (by the CRC of its id) in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = merkle_bitmap.manifest(docs, F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text")))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle_bitmap.proof_digest(F.col("path")).alias("proof_sha256"),
                       merkle_bitmap.fold(F.col("path"), F.col("probe")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, roots and proof of every document, and the root its tampered text gives."""
    return op12_columns(read_table(spark, sf_dir, "documents", merkle_bitmap.FIELDS))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 8 leading components of unit variance."""
    made = chebyshev_whiten.whiten(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), ["vec_id"])
    return made.withColumn("deviation", chebyshev_whiten.deviation_long())


QUERIES = {"op1_simhash": op1_simhash, "op2_decontaminate": op2_decontaminate, "op3_license": op3_license, "op4_substrings": op4_substrings, "op5_langid": op5_langid,
           "op6_pii": op6_pii, "op7_secrets": op7_secrets, "op8_bpe": op8_bpe, "op9_topk": op9_topk, "op10_chat": op10_chat,
           "op11_fingerprint": op11_fingerprint, "op12_merkle": op12_merkle, "op13_whiten": op13_whiten}

ORACLES = {
    "op4_substrings": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (h) WHERE first < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op9_topk": """
WITH usable AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
ints AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM usable),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""",
    "op10_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS total
  FROM rows),
run AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR i = total) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id""",
}


#: levels that the SQL tree spells out: 16**4 documents a source, 16**2 sources
SQL_LEVELS, SQL_TOP_LEVELS = 4, 2


def _merkle_sql() -> str:
    """The manifest in SQL: leaves numbered by window functions, each level spelled out; a
    level's ``lo`` and ``hi`` are the siblings left and right (empty once one node is left)."""
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 of the decimal id, bit by bit
    crc = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    ctes = [f"""base AS (SELECT doc_id, source, coalesce('=' || source, '') AS k, sha256({head} || {field('text')}) AS leaf,
  sha256({head} || CASE WHEN text IS NOT NULL AND {crc} % 5 = 0 THEN {field(text)} ELSE {field('text')} END) AS probe FROM documents)""",
            "t0 AS (SELECT k, leaf AS h, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf, probe FROM base)"]

    def level(name: str, below: str, cols: str) -> list[str]:
        run = "PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN"
        return [f"""{name}_p AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lo,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS hi FROM {below})""",
                f"""{name} AS (SELECT k, i // 16 AS i, max((n + 15) // 16) AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {below} GROUP BY k, i // 16)"""]

    for lv in range(1, SQL_LEVELS + 1):
        ctes += level(f"t{lv}", f"t{lv - 1}", "")
    top = f"t{SQL_LEVELS}"
    ctes.append(f"s0 AS (SELECT '' AS k, h, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(k)) - 1 AS i, k AS source_key FROM {top})")
    for lv in range(1, SQL_TOP_LEVELS + 1):
        ctes += level(f"s{lv}", f"s{lv - 1}", "")
    steps = [f"p{lv}" for lv in range(1, SQL_LEVELS + 1)] + [f"u{lv}" for lv in range(1, SQL_TOP_LEVELS + 1)]
    joins = " ".join(f"JOIN t{lv}_p p{lv} ON p{lv}.k = l.k AND p{lv}.i = l.i // {16 ** (lv - 1)}" for lv in range(1, SQL_LEVELS + 1))
    joins += " JOIN s0 ON s0.source_key = l.k "
    joins += " ".join(f"JOIN s{lv}_p u{lv} ON u{lv}.i = s0.i // {16 ** (lv - 1)}" for lv in range(1, SQL_TOP_LEVELS + 1))
    proof = " || ".join(f"{s}.lo || {s}.hi" for s in steps)
    folded = [f"f0 AS (SELECT l.doc_id, l.leaf, s0.h AS subroot, r.h AS root, sha256({proof}) AS proof_sha256, l.probe AS x, "
              + ", ".join(f"{s}.lo AS {s}_lo, {s}.hi AS {s}_hi, {s}.n AS {s}_n" for s in steps)
              + f" FROM t0 l {joins} JOIN s{SQL_TOP_LEVELS} r ON true)"]
    for j, s in enumerate(steps):
        folded.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {s}_n > 1 THEN sha256({s}_lo || x || {s}_hi) ELSE x END AS x) FROM f{j})")
    return ("WITH " + ",\n".join(ctes + folded)
            + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM f{len(steps)}")


ORACLES["op12_merkle"] = _merkle_sql()
