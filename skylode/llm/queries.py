"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.llm import byte_bpe, chat_format, interp_lm, lang_cnn, packing, pivot_topk, quality_rules, simhash, token_transducer, toxicity
from skylode.llm.common import table, written


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = lang_cnn.is_held_out()
    model = lang_cnn.train(documents.filter(~held_out))
    return lang_cnn.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interp_lm.score(table(spark, sf_dir, "documents"), interp_lm.is_held_out(), least=1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(written(pieces, "pieces"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_count": op1_token_count,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality_rules": op3_quality_rules,
        "op4_pivot_top_k": op4_pivot_top_k,
        "op5_chat_format": op5_chat_format,
        "op6_language_id": op6_language_id,
        "op7_toxicity": op7_toxicity,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_interpolated_lm": op9_interpolated_lm,
        "op10_best_fit_packing": op10_best_fit_packing,
    }
