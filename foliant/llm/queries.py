"""The operators applied to the whole standard tables: one thin query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe_tree, chat, exact_dedup, fingerprint, html_text, near_dedup, packing, quality, secrets, token_files
from foliant.llm.common import spread

#: Where the public vocabularies lie; replace to use others of the same form.
vocabulary = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.digests(files)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(spread(_table(spark, sf_dir, "documents")))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits_in_turn(_table(spark, sf_dir, "documents"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(spread(_table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(*chat.swapped_replies(_table(spark, sf_dir, "conversations")))

    def trained(name: str):  # noqa: ANN202
        return F.array_join(F.transform(F.filter(name, lambda s: s["train"]), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return pairs.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected", trained("chosen_spans").alias("chosen_train"), trained("rejected_spans").alias("rejected_train"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(_table(spark, sf_dir, "pages")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(_table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"), end_id=0, room=2048)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spread(_table(spark, sf_dir, "documents"))).drop("found")


QUERIES = {
    f.__name__: f
    for f in (op1_token_files, op2_near_dedup, op3_fingerprint, op4_bpe_tree, op5_preference_pairs, op6_html_text, op7_packing, op8_exact_dedup, op9_quality, op10_secrets)
}

ORACLE_SQL = {
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS k FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY k) AS group_size, first_value(doc_id) OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS keep_id FROM d
        )
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, n_chars, sha256(k) AS text_sha256 FROM g
    """,
    "op5_preference_pairs": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), last AS (
            SELECT conv_id, max(turn) AS lt, arg_max(text, turn) AS reply FROM turns WHERE role = 'assistant' GROUP BY conv_id
        ), swap AS (
            SELECT conv_id, lt, reply, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS other FROM last
        ), cut AS (
            SELECT t.conv_id, t.turn, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body, s.reply = s.other AS same, t.turn = s.lt AS is_last, s.other || '<|im_end|>' || chr(10) AS swapped
            FROM turns t JOIN swap s ON t.conv_id = s.conv_id AND t.turn <= s.lt
        ), pair AS (
            SELECT conv_id AS pair_id,
                CAST(count(*) FILTER (WHERE same OR NOT is_last) AS BIGINT) AS prompt_turns,
                coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (WHERE same OR NOT is_last), '') AS prompt,
                coalesce(max(head || body) FILTER (WHERE is_last AND NOT same), '') AS chosen,
                coalesce(max(head || swapped) FILTER (WHERE is_last AND NOT same), '') AS rejected,
                max(length(head)) FILTER (WHERE is_last) AS skip
            FROM cut GROUP BY conv_id
        )
        SELECT pair_id, prompt_turns, prompt, chosen, rejected,
            CASE WHEN chosen = '' THEN '' ELSE concat(length(prompt) + skip, ':', length(prompt) + length(chosen)) END AS chosen_train,
            CASE WHEN rejected = '' THEN '' ELSE concat(length(prompt) + skip, ':', length(prompt) + length(rejected)) END AS rejected_train
        FROM pair
    """,
}
