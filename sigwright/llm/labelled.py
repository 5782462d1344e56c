"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of a sample: labelled documents with the smallest hashes of their id.
SAMPLE_ROWS = 8000


def held_out(id_col: str) -> Column:
    """Whether an id is in the fold whose labels are never learnt from: crc32 of its text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label 0/1) of at most ``rows`` labelled documents outside the held-out fold.

    Rows with a null id, text or label are left out. An id that occurs again counts once, with its largest
    label and text. Ids are chosen before texts are read, and sent to the scan of docs (bounded by ``rows``).
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label) > 0).cast("int").alias("label")).dropna().filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    there = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    chosen = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
