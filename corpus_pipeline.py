"""Corpus pipeline over documents: each stage applies one operator to all that its predecessor kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet to the shared folder
and read again, so none repeats the work before it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwright.llm import mixing, neardup, pieces, substrings, toxicity
from sigwright.llm.queries import tokenizer_path
from sigwright.runtime import Cut, release_memory, release_shuffles, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Characters of a plan's description in Spark's status store and event log.
PLAN_TEXT = 4000
#: Bytes of a batch of rows for a Python worker, and of what it makes of them: Spark's own bound is so high that a task's
#: rows are one batch, which the executor, outside its heap, and the worker hold several times.
BATCH_BYTES = 2 << 20


def lean(stage: Stage) -> Stage:
    """A stage that begins by letting go what stages before it have left in the driver: plans that nothing refers to any
    more, with their shuffle files, and memory. What Spark writes about a plan, anew with each of its steps, and keeps of a
    thousand plans, is cut at PLAN_TEXT characters. Batches get BATCH_BYTES unless the session has a bound of its own; this one
    stays, as what a stage returns is computed later."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_memory()
        release_shuffles(spark)
        batch = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(batch, None) is None:
            spark.conf.set(batch, str(BATCH_BYTES))
        name = "spark.sql.maxPlanStringLength"
        before = spark.conf.get(name)
        spark.conf.set(name, str(PLAN_TEXT))
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(name, before)

    return run_stage


@lean
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    scored = toxicity.score_documents(docs, model, keep=tuple(docs.columns), score=score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).drop(score)


@lean
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return neardup.first_of_each(docs)


@lean
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; n_chars follows the text."""
    return _counted(substrings.deduplicated(docs), docs)


@lean
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; n_chars follows the text."""
    return _counted(mixing.materialise(docs), docs)


@lean
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and what they decode to."""
    return pieces.encode_documents(docs, tokenizer_path(), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids_sha256", "ids", "decoded"))


def _counted(made: DataFrame, docs: DataFrame) -> DataFrame:
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("substrings", passages),
    ("mixing", mixed),
    ("pieces", tokens),
]
#: SQL can express neither the classifier nor the tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Cut(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
