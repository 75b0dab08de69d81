"""The registered queries of the ten operators, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontamination, langid, line_dedup, mixing, mtree, ngram_join, quality, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(urls.RULES, "action string, entry string"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_mixing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=None, entropy=0.9)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50; all are searched."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), asked=F.col("id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.offending(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def _by_parity(spark: SparkSession, docs: DataFrame) -> line_dedup.LineStore:
    """Two batches, of even and of odd ids: the second probes the filters of the first."""
    return line_dedup.LineStore.empty(spark).insert(docs.where("doc_id % 2 = 0")).insert(docs.where("doc_id % 2 != 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _by_parity(spark, docs).dedup(docs)


def op9_line_dedup_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, after the documents whose ids end in 0 have been deleted again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone, left = docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 != 0")
    return _by_parity(spark, docs).delete(gone).dedup(left)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_language_mixture, op4_mtree_topk, op5_toxicity, op6_decontamination, op7_chat_format, op8_quality, op9_line_dedup, op10_ngram_jaccard, op2_mixing_entropy, op9_line_dedup_delete)}

ORACLES: dict[str, str] = {
    "op1_url_filter": urls.ORACLE,
    "op2_mixing": mixing.oracle(),
    "op2_mixing_entropy": mixing.oracle(max_repeats=None, entropy=0.9),
    "op4_mtree_topk": mtree.oracle(asked="id % 50 = 0"),
    "op6_decontamination": decontamination.oracle(),
    "op7_chat_format": chat.ORACLE,
    "op9_line_dedup": line_dedup.oracle("doc_id % 2"),
    "op9_line_dedup_delete": line_dedup.oracle("doc_id % 2", "doc_id % 10 = 0"),
    "op10_ngram_jaccard": ngram_join.oracle(),
}
