"""Queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagesheaf.llm.bpe import encoding_digests
from pagesheaf.llm.common import table
from pagesheaf.llm.forest import nearest
from pagesheaf.llm.language import identify_language
from pagesheaf.llm.licenses import license_scan
from pagesheaf.llm.mixing import mixed_order
from pagesheaf.llm.oracles import ORACLES
from pagesheaf.llm.packing import pack
from pagesheaf.llm.quality import classify_quality
from pagesheaf.llm.search import top_documents
from pagesheaf.llm.simhash import near_groups
from pagesheaf.llm.token_counts import token_counts
from pagesheaf.llm.toxicity import classify_toxicity
from pagesheaf.llm.trie import conversation_trie
from pagesheaf.llm.whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", limit=512)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=4, threshold=4)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"), folds=5, held=0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), threshold=0.9)


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), k=10, query_terms=None, by_frequency=True)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, recall=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify_quality(docs, labels, folds=5, held=0, threshold=0.3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify_toxicity(docs, labels, folds=3, held=1, threshold=0.7)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json")
    return pack(counts, lengths=(512, 1024, 2048, 4096, 8192), separator=1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_order(table(spark, sf_dir, "documents"), max_passes=2.0, block_tokens=1_000_000)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_licenses": op4_licenses,
    "op5_search": op5_search,
    "op6_nearest": op6_nearest,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_trie": op12_trie,
    "op13_bpe": op13_bpe,
}

__all__ = ["ORACLES", "QUERIES"]
