"""One query for each operator over its whole table, with the digests that are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, fingerprints, line_dedup, near_dedup, sharding, substring_dedup, token_files, toxicity
from .columns import sha256, table
from .scratch import cut, fresh_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), bpe_pattern()
    back = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, and_decode=True)
    return back.select("doc_id", "n_tokens", sha256(F.col("ids")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), fresh_path(spark, "token-files"))
    back = token_files.read(spark, cut(made, "token-manifest"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    hashes, written = fingerprints.hashes, fingerprints.written
    made = made.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), sha256(F.col("edited")).alias("edited_sha256"), "chosen", "edited_chosen",
        hashes(F.col("chosen")).alias("a"), hashes(F.col("edited_chosen")).alias("b"), hashes(F.col("next_chosen")).alias("c"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("chosen")).alias("fingerprint"), written(F.col("edited_chosen")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("near_edited"), fingerprints.likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.chat_format(chat_format.as_log(turns.unionByName(more)))
    formatted = F.col("formatted")
    back = made.select("conv_id", "formatted", chat_format.parse(formatted).alias("turns"), chat_format.under_loss(formatted, F.col("loss")).alias("trained"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha256(line).alias("turns_sha256"), F.char_length("trained").cast("bigint").alias("loss_chars"),
        sha256(F.col("trained")).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_line_dedup, op3_toxicity, op4_decontamination, op5_byte_bpe, op6_sharding, op7_near_dedup, op8_token_files, op9_fingerprints, op10_chat_format,
)}
