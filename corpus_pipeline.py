"""From raw documents to packed training sequences: five stages, each one operator of tessera.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stash, stashed, sweep
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.language import filter_languages
from tessera.llm.mixing import mix_documents
from tessera.llm.near_dups import drop_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.registry import table, word_tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no language: no letter, or bytes that fit none of the learned languages.

    Null and empty texts go. Rows without doc_id or lang are judged like others. Repeated rows go or stay together; other
    columns pass through; an empty table stays empty."""
    return filter_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays.

    A null text equals an empty one, a null doc_id is below every other. Of rows that repeat both, one stays. Other columns
    pass through; an empty table stays empty."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Texts without words and rows without doc_id stay. The texts of a repeated doc_id go or stay by themselves. Other columns
    pass through; an empty table stays empty."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take nine tenths of the words, by the weights of domains, languages and sources, nothing twice.

    Null levels are a leaf of their own; a leaf without words, or of weight 0, is not taken. Ties in a leaf's order go by
    doc_id, and repeated rows are taken together. Other columns pass through; an empty table stays empty."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    Null and empty texts are one piece of the end token. Repeated rows are packed each; other columns are not read; an
    empty table gives an empty result."""
    return pack_documents(docs, word_tokenizer())


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: The language model, the signatures and the tokens are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again.

    When a stage is written, the tables that it made on the way, and its input, are deleted. Nulls, empty texts, repeated
    rows and extra columns are as each stage says; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    begin = stashed(spark)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, begin, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
