"""The queries of this subpackage, each thin around its operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bin_completion, bpe, hd_langid, minhash_dedup, quality, separator_scan, surrogates, token_store, toxicity, winnowing
from siltstone.llm.common import documents, durable, labels

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_OF_TEXT = 50256
SEQUENCE = 2048


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents; odd rows as ``near_duplicates`` says."""
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; a null text is empty, extra columns are left out."""
    return bpe.encoding_digests(documents(spark, sf_dir), MULTI_RANKS, public_tokenizers.PATTERN)


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of their ids; a null text has none."""
    blocks = separator_scan.write_flat(documents(spark, sf_dir), BYTE_BPE_RANKS, public_tokenizers.PATTERN, END_OF_TEXT)
    return separator_scan.count_tokens(durable(blocks, "flat-tokens"), END_OF_TEXT).select("doc_id", "n_tokens")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next document; odd rows as ``compare_with_edits`` says."""
    return winnowing.compare_with_edits(documents(spark, sf_dir))


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; odd rows as ``pack`` says."""
    return bin_completion.pack(documents(spark, sf_dir), BYTE_BPE, SEQUENCE)


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged; odd rows as ``judge`` says."""
    return quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; odd rows as ``predict_languages`` says."""
    return hd_langid.predict_languages(documents(spark, sf_dir))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, by the session's key; odd rows as ``replace_entities`` says."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace_entities(docs, surrogates.distinct_key(docs, surrogates.session_key(spark)))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store and read back; odd rows as ``write_store`` says."""
    return token_store.write_store(documents(spark, sf_dir), BYTE_BPE).digests()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; odd rows as ``score_documents`` says."""
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash_dedup.ORACLE}
