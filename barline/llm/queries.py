"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import chat, codes, hnsw, minhash, mixing, phrases, substrings
from barline.llm.stage import small_batches

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.mixing import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    out = mixed(docs, narrow=True)
    return out.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("probability", 6).alias("probability"),
        F.round("repeat_weight", 6).alias("repeat_weight"), "kept",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.decontaminate import judged

    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "item_id", F.round("lcs_share", 6).alias("lcs_share"), F.round("cosine", 4).alias("cosine"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barline.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), spark, public_tokenizers.path(TOKENIZER))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.minhash import components

    return components(table(spark, sf_dir, "documents"))


def op7_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.chat import conversation_digests, formatted_turns

    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = conversation_digests(formatted_turns(rows.unionByName(probe)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "bad_turn")


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "rejected")


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_substring_dedup, op3_decontamination, op4_token_counts, op5_main_text, op6_near_duplicates, op7_chat_turns, op8_secret_spans, op9_quality_rules, op10_toxicity, op11_embedding_duplicates, op12_phrases, op13_vector_codes)}
SQL: dict[str, str] = {"op1_mixing": mixing.sql(), "op2_substring_dedup": substrings.sql(), "op6_near_duplicates": minhash.sql(), "op7_chat_turns": chat.sql(), "op11_embedding_duplicates": hnsw.sql(), "op12_phrases": phrases.sql(), "op13_vector_codes": codes.sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
