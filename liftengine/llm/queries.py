"""The queries of the training-data operators, one per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftengine.llm import (
    conversations, fingerprints, jaccard, mixing, mixture_packing, packing, pii, quality,
    sharding, suffixes, templates, token_files, twins, vector_codes,
)
from liftengine.llm.common import table
from liftengine.sources.scratch import scratch_path

SEQUENCE = 4096


def vocabulary() -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary(), end=2)
    return token_files.read_tokens(spark, path)


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), columns=("doc_id",)).drop("copies")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast(
            "bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in pii.PATTERNS],
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.concat("base", "terms")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), SEQUENCE, vocabulary(), end=1)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lost_lines",
        F.sha2("clean_text", 256).alias("clean_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    hashed = conversations.digests(made.pieces).select(
        F.col("conv_id").alias("of"), F.col("sha256").alias("repaired_sha256"))
    return made.conversations.join(
        hashed, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def byte_level() -> tuple[str, str, str]:
    """The installed byte-level vocabulary: its file, its ranks and their pattern."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"), byte_level(), end=1)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        "codebooks_sha256")


def queries() -> dict:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_token_files": op2_token_files,
        "op3_templates": op3_templates,
        "op4_suffixes": op4_suffixes,
        "op5_jaccard": op5_jaccard,
        "op6_mixing": op6_mixing,
        "op7_pii": op7_pii,
        "op8_packing": op8_packing,
        "op9_sharding": op9_sharding,
        "op10_quality": op10_quality,
        "op11_conversations": op11_conversations,
        "op12_mixture_packing": op12_mixture_packing,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return twins.all_sql()
