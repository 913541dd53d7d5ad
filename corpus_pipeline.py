"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept and returns those it keeps, with the columns of documents. The last
returns the packed pieces. No documents give no rows in any stage; columns beside
doc_id, text and lang, whatever their names, are handed on unread; rows that repeat
are judged alike, and all but one of them go in the third stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skylode.llm import packing, quality_rules, simhash, toxicity
from skylode.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejecting severity, by a model learned from the labels.

    A null or empty text, or one without a word of the vocabulary, has severity 0 and
    stays; long texts are read whole. Without labels all stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep.

    A null or empty text fails the base rules (under 50 words) and goes. Without labels
    only the base rules apply; a null lang is a stratum of its own.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles
    within three bits, the radius of the operator's query.

    The smallest id stays, null ids last, of equal ids any one. Null and empty texts have
    one fingerprint.
    """
    return simhash.keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is a piece of one token, its end; a long one several pieces.
    """
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(written(pieces, "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_documents),
]

#: The toxicity model and the fingerprints are beyond SQL; tests/llm holds the
#: stages against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
