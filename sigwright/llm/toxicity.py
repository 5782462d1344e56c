"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios (operator 9).

A text is the set of its hashed 4-, 5- and 6-grams of code points, lower-cased and framed by blanks. On
labelled texts each bucket gets the log ratio of its smoothed document frequencies in the two classes; the
buckets that tell the classes apart best are kept, and a logistic model is fitted on presence times ratio,
each text scaled to length one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.llm.labelled import SAMPLE_ROWS, held_out, sample
from sigwright.runtime import Cut, release_memory

ORDERS = (4, 5, 6)
BITS = 18
#: Buckets kept by the model, those that tell the classes apart best: what a few labelled texts alone have is noise.
FEATURES = 2048
STEPS = 200
THRESHOLD = 0.3


@dataclass
class ToxicModel:
    """slot: bucket to feature, 0 where it is none; ratio and weight by feature (0: unused)."""

    slot: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, text: str) -> np.ndarray:
        seen = np.zeros(len(self.ratio), bool)
        for h in buckets(text):
            seen[self.slot[h]] = True
        seen[0] = False
        return seen

    def score(self, text: str) -> float:
        seen = self.present(text)
        r = self.ratio[seen]
        norm = max(1.0, float(np.sqrt(r @ r)))
        return float(1 / (1 + np.exp(-(self.bias + float(r @ self.weight[seen]) / norm))))


def buckets(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, one array for each n."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(len(chars), 0x9E3779B97F4A7C15, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ chars[n - 1 :]) * np.uint64(0x100000001B3D4E5F)
        if n in ORDERS:
            yield (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> ToxicModel:
    """Fits on a bounded sample of the labelled documents outside the held-out fold (see labelled.sample).

    With one class only, or no row, the model scores every text with the smoothed share of label 1. What
    reaches the driver is bounded by 2**BITS counts and sample_rows * features indices. features: buckets that the
    model keeps; n-grams in others don't count.
    """
    chosen = Cut(sample(docs, labels, label, sample_rows).select("text", "label").repartition(24), "toxic-sample")
    try:
        return _fit(chosen.df, features)
    finally:
        chosen.drop()


def _fit(rows_in: DataFrame, features: int) -> ToxicModel:
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros((2, size), np.int64)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen = np.zeros(size, bool)
                for h in buckets(value.as_py()):
                    seen[h] = True
                docs[int(y > 0)] += seen
                totals[int(y > 0)] += 1
        at = np.flatnonzero(docs.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(docs[0, at], totals[0])), pa.array(np.append(docs[1, at], totals[1]))], names=["bucket", "clean", "toxic"])
        release_memory()

    rows = rows_in.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    total = rows[rows.bucket == -1]
    clean, toxic = (int(total.clean.sum()), int(total.toxic.sum())) if len(total) else (0, 0)
    slot = np.zeros(size, np.int16)
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return ToxicModel(slot, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rows = rows[rows.bucket >= 0].sort_values("bucket")
    q, p = rows.clean.to_numpy(float), rows.toxic.to_numpy(float)
    ratio = np.log(((p + 1) / (toxic + 2)) / ((q + 1) / (clean + 2)))
    share = (p + q + 1) / (clean + toxic + 2)
    worth = (p / toxic - q / clean) ** 2 / (share * (1 - share))
    best = np.sort(np.argsort(-worth, kind="stable")[:features])
    slot[rows.bucket.to_numpy()[best]] = np.arange(1, len(best) + 1)
    model = ToxicModel(slot, np.append(0.0, ratio[best]), np.zeros(len(best) + 1), float(np.log(toxic / clean)))

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(model.present(value.as_py())).astype(np.int32).tobytes() for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "features"])
        release_memory()

    # rows are sorted: sums in the fit, and so the model, do not depend on the order of tasks
    fitted = sorted((r.label, bytes(r.features)) for r in rows_in.mapInArrow(indices, "label int, features binary").collect())
    y = np.array([label > 0 for label, _ in fitted], float)
    owner = np.repeat(np.arange(len(y)), [len(x) // 4 for _, x in fitted])
    flat = np.frombuffer(b"".join(x for _, x in fitted), np.int32)
    value = model.ratio[flat]
    value = value / np.maximum(1.0, np.sqrt(np.bincount(owner, value**2, len(y))))[owner]
    w, b, gw, gb = model.weight, model.bias, np.zeros(len(model.weight)), 0.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(np.bincount(owner, value * w[flat], len(y)) + b))) - y
        g = np.bincount(flat, value * miss[owner], len(w)) / len(y) + 1e-5 * w
        gw += g * g
        w -= 0.5 * g / (np.sqrt(gw) + 1e-8)
        gb += miss.mean() ** 2
        b -= 0.5 * miss.mean() / (np.sqrt(gb) + 1e-8)
    model.bias = float(b)
    return model


def score_documents(docs: DataFrame, model: ToxicModel, text: str = "text", keep: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """``keep`` columns of docs and the score, 0 to 1, of each whole text (null counts as empty).

    The model (under 1 MB) is broadcast; rows are independent, so there is no shuffle. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [own.score(value.as_py() or "") for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, score])
        release_memory()

    fields = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)
    return source.mapInArrow(run, f"{fields}{', ' if fields else ''}`{score}` double")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row of docs."""
    scored = score_documents(docs, fit(docs, labels), keep=("doc_id",))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
