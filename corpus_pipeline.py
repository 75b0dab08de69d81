"""The corpus pipeline: documents from raw to a mixture, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is
written as Parquet in the shared folder and reread. All but the last return the columns of docs.
Rows with a null doc_id pass the filters that are keyed by document; rows with a null text go in the first stage, and the
last draws no row without tokens. Of rows that repeat an id all stay or go together, but for the first two stages, which
judge each text. Extra columns of documents, whatever their names, are carried along unchanged up to the last stage.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, line_dedup, mixing, ngram_join, quality
from quillon.llm.scratch import collecting, delete, fresh, written
from quillon.session import ship

QUALITY_THRESHOLD = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects go, and so do null texts. An empty text is scored like any other."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines owned by an earlier document are cut out of the text (n_chars follows); a document that had text and has
    none left goes."""
    (removed,) = fresh(docs.columns, "removed")
    out = line_dedup.LineStore.empty(spark).insert(docs).dedup(docs, removed_col=removed)
    out = out.where((F.col(removed) == 0) | (F.btrim("text", F.lit(line_dedup.SPACE + "\n")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by near-duplicate pairs the document with the smallest id stays."""
    return ngram_join.keep_one(docs, written(ngram_join.duplicate_classes(docs), "pipeline-classes"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go."""
    return decontamination.clean(docs, written(decontamination.leaks(docs, _table(spark, sf_dir, "benchmark")), "pipeline-leaks"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What to read, how often and in which block of the mixture."""
    return mixing.mix(docs)


#: Scratch tables of the stage that ran last, by thread and input, and that stage's number.
_made: dict[tuple[int, str], tuple[int, list[str]]] = {}


def _stage(number: int, f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """When a stage begins, its docs have been written, so the scratch tables of the stage before are read no more and go
    first, unless docs do read them. All others go when the application ends."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        last, paths = _made.pop((threading.get_ident(), sf_dir), (0, []))
        if paths and last == number - 1:
            read = {p.split(":", 1)[-1].lstrip("/") for p in docs.inputFiles()}
            delete(spark, [p for p in paths if not any(x.startswith(p.split(":", 1)[-1].lstrip("/") + "/") for x in read)])
        _made[threading.get_ident(), sf_dir] = number, (mine := [])
        with collecting(mine):
            return f(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", _stage(0, quality_classifier)),
    ("line dedup", _stage(1, line_deduplication)),
    ("n-gram Jaccard join", _stage(2, ngram_jaccard_join)),
    ("benchmark decontamination", _stage(3, benchmark_decontamination)),
    ("mixing sources to target weights", _stage(4, mixture)),
]

#: The network's decisions can't be put in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of the stages' results only the last is left."""
    ship(spark)
    docs, results = _table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        with collecting(mine := []):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
        delete(spark, results)
        results = mine
    return docs
