"""The registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    chat_format, corpus_queries, exact_dedup, language_id, packing, pieces, ppm, quality_rules, simhash, token_counts, warc,
)
from palisade.llm.common import held_out, materialize, new_folder, shared_folder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder, one per input folder."""
    cache = f"{shared_folder(spark)}/palisade-llm/token-cache-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), cache, TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 7, 2)
    scored = ppm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, PIECE_MODEL).select("doc_id", "text", "encoded.ids", "encoded.score")
    return pieces.decode(encoded, PIECE_MODEL).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), "score",
        F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled, _ = language_id.identify(docs, ~held)
    return labelled.select(
        "doc_id", held.alias("held_out"), F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return assessed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The conversation that holds the template's own marks.
MARKED_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(MARKED_CHAT, "conv_id bigint, turn bigint, role string, text string")
    )
    chats = chat_format.format_chats(rows)
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(read.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = materialize(
        warc.read_archives(spark, folder).select(
            "page_id", "record_type", "record_id", "refers_to_id", "payload_digest",
            F.octet_length("payload").cast("bigint").alias("bytes"),
        ),
        "warc-records",
    )
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("target_page"), F.col("bytes").alias("target_bytes")
    )
    # Only revisits refer to a record; a join of all records would send every response to the task of the null key.
    revisits = records.filter("record_type = 'revisit'").join(responses, F.col("refers_to_id") == F.col("target"), "left").select(
        "page_id", F.coalesce("bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("target_page").alias("refers_to"),
    )
    return records.filter("record_type <> 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(revisits)


def packed_pieces(docs: DataFrame) -> DataFrame:
    cut = materialize(
        packing.pieces(docs, TOKENIZER).select(
            "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
        ),
        "pieces",
    )
    return packing.pack(cut, 1024, ["doc_id", "piece", "start", "ids_crc32"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.as_hex("fingerprint"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_ppm_scores, op3_exact_dedup, op4_pieces, op5_language_id, op6_quality_rules,
        op7_chat_format, op8_warc, op9_packing, op10_simhash,
    )
} | corpus_queries.QUERIES

_EXACT = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS rank,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, text_sha256 FROM r
"""

_CHATS = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '</turn>') OR contains(text, '### ')
    THEN length(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### '), ': ', '\: '))
    ELSE length(text) END AS shown_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + shown_chars + 7 + 1) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (
  SELECT page_id, strlen(payload) AS payload_bytes, hex,
         row_number() OVER (PARTITION BY payload ORDER BY page_id) AS rank,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         CAST(concat('0x', substr(hex || '0', 1 + i * 5 // 4, 2)) AS INT) // CAST(pow(2, 3 - i * 5 % 4) AS INT)
       ) % 32 AS INT), 1) for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN rank = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rank > 1 THEN first_id END AS refers_to
FROM r
"""

ORACLES = {"op3_exact_dedup": _EXACT, "op7_chat_format": _CHATS, "op8_warc": _WARC} | corpus_queries.ORACLES
