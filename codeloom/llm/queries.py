"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import chat, language_id, line_dedup, ngram_join, packing, piece_codec, quality, suffix_dedup, token_files, topk


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"), 50)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=4, similarity_pct=85)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, 0)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_lines(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = language_id.train(docs.filter(~language_id.held_out() & F.col("doc_id").isNotNull()))
    return language_id.identify(docs, trees).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_topk": op7_exact_topk,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op7_exact_topk": topk.ORACLE_SQL,
    "op9_line_dedup": line_dedup.PAGES_SQL,
}
