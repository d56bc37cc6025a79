"""The queries over the dealt operators, with production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html, imatch, mixing, packing, pii, simhash, tokens, toxicity
from ._common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    every = pii.spans_text(F.concat("base", "found"))
    return found.select("doc.doc_id", *n, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), every.alias("spans"), F.size("found").cast("long").alias("n_added"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc.doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of each pair's prompt and completions as rendered, with the mask of its trained span."""
    segments = chat.formatted(chat.worsened(table(spark, sf_dir, "conversations")))
    return segments.select(F.col("pair_id").alias("conv_id"), "part", "turn", "rendered", "train", "train_from", "train_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mixing.mix(table(spark, sf_dir, "documents"))
    first = F.min_by(F.struct("shard", "position"), F.struct("lap", "from_word"))  # where the tree and the shuffle put its first piece
    whole = pieces.groupBy("doc_id", "source", "copy", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"), F.count("shard").alias("n_pieces"), first.alias("at"))
    return whole.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", F.col("at.shard").alias("shard"), F.col("at.position").alias("position"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_imatch": op3_imatch,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_preference": op7_preference,
    "op8_mixing": op8_mixing,
    "op9_neighbours": op9_neighbours,
    "op10_html": op10_html,
}

OP7_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
bad AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN c.turn = l.last AND c.role = 'assistant' THEN array_to_string(list_reverse(string_split(c.text, ' ')), ' ') ELSE c.text END AS text
  FROM conversations c LEFT JOIN last l USING (conv_id)),
differs AS (
  SELECT c.conv_id, min(c.turn) AS first FROM conversations c JOIN bad b USING (conv_id, turn)
  WHERE c.text IS DISTINCT FROM b.text GROUP BY c.conv_id),
parts AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
         CASE WHEN d.first IS NULL OR c.turn < d.first THEN 'prompt' ELSE 'chosen' END AS part
  FROM conversations c LEFT JOIN differs d USING (conv_id)
  UNION ALL
  SELECT b.conv_id, b.turn, b.role, b.text, 'rejected' FROM bad b JOIN differs d USING (conv_id) WHERE b.turn >= d.first),
segments AS (
  SELECT conv_id, part, turn, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         coalesce(text, '') || '<|end|>' || chr(10) AS body, part <> 'prompt' AND coalesce(role = 'assistant', false) AS train
  FROM parts)
SELECT conv_id, part, turn, head || body AS rendered, train,
       CASE WHEN train THEN CAST(length(head) AS BIGINT) END AS train_from,
       CASE WHEN train THEN CAST(length(head || body) AS BIGINT) END AS train_to
FROM segments
"""

#: The other operators (tokenisation, hashing, fitted models, seeded draws) have no SQL form; the tests
#: hold them against brute force, exact round trips or held-out labels.
ORACLE_SQL = {"op7_preference": OP7_SQL}
