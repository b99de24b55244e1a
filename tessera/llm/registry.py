"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import dedup_report
from tessera.llm.htmltext import extract_text
from tessera.llm.language import predict_languages
from tessera.llm.mixing import mix_report
from tessera.llm.near_dups import near_duplicates
from tessera.llm.oracle import ORACLE as ORACLE
from tessera.llm.packing import pack_documents
from tessera.llm.privacy import pseudonymize
from tessera.llm.quality import judge_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.spelling import group_variants
from tessera.llm.substrings import drop_repeats
from tessera.llm.warc import archive_pages
from tessera.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def privacy_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms, from spark.tessera.privacyKey; a new one for each call where that is unset."""
    given = spark.conf.get("spark.tessera.privacyKey", None)
    return given.encode() if given else secrets.token_bytes(32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rendezvous_shards": _documents(shard_documents),
    "op2_mix_sources": _documents(mix_report),
    "op3_ngram_jaccard_join": _documents(near_duplicates),
    "op4_pattern_packing": _documents(lambda docs: pack_documents(docs, word_tokenizer())),
    "op5_warc_roundtrip": lambda spark, sf_dir: archive_pages(table(spark, sf_dir, "pages")),
    "op6_pii_pseudonyms": _documents(lambda docs: pseudonymize(docs, privacy_key(docs.sparkSession))),
    "op7_cuckoo_dedup": _documents(lambda docs: dedup_report(docs).drop("keep_rows")),
    "op8_ppm_language": _documents(predict_languages),
    "op9_divergence_quality": _documents(judge_quality),
    "op10_seed_extend": _documents(drop_repeats),
    "op11_embedding_whitening": lambda spark, sf_dir: whiten(table(spark, sf_dir, "embeddings")),
    "op12_spelling_variants": _documents(group_variants),
    "op13_template_text": lambda spark, sf_dir: extract_text(table(spark, sf_dir, "pages")),
}
