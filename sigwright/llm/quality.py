"""Quality by hierarchical empirical Bayes (operator 3).

A logistic classifier gives each document a probability from features of its text. Hosts and paths sum up
that evidence: a host's posterior is its mean, shrunk to the global one by as many pseudo-documents as the
spread between hosts calls for; a path's posterior is shrunk to its host's in the same way. A document's
score adds to its own log odds how far the rest of its path lies above or below the global prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwright.llm.labelled import SAMPLE_ROWS, sample
from sigwright.runtime import Cut

#: Probabilities are summed as whole numbers of this unit, so that sums do not depend on the order of tasks.
UNIT = 1_000_000
#: Bounds of the pseudo-documents that a prior counts as.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0
THRESHOLD = 0.5
STEPS = 60
RIDGE = 1e-2
N_FEATURES = 12


def features(text: str | None) -> np.ndarray:
    """Shares and means over a whole text; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(N_FEATURES)
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    count = np.bincount(data, minlength=256)
    upper, digits = count[65:91].sum(), count[48:58].sum()
    letters = count[97:123].sum() + upper + count[128:].sum()
    blanks = count[9:14].sum() + count[32]
    lines = raw.split(b"\n")
    forms: dict[bytes, int] = {}
    for w in words:
        forms[w] = forms.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.array([
        upper / max(1, letters),
        digits / n,
        (n - letters - digits - blanks - count[46] - count[44]) / n,
        count[124] / len(words),
        count[33] / len(words),
        (count[36] + count[37] + count[38] + count[42] + count[35]) / len(words),
        again / len(words),
        max(forms.values()) / len(words),
        len(forms) / len(words) ** 0.75,
        lengths.mean() / 10,
        len(set(lines)) / len(lines),
        np.log1p(len(words)) / 10,
    ])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) of the classifier, from a bounded sample of labelled documents.

    With one class only, or no row, the weights are 0 and the bias is the smoothed log odds.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(v.as_py()).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["x", "label"])

    rows = sorted((r.label, bytes(r.x)) for r in sample(docs, labels, label, sample_rows).select("text", "label").mapInArrow(extract, "x binary, label int").collect())
    y = np.array([r[0] for r in rows], float)
    x = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), N_FEATURES)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(rows) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w = np.zeros(N_FEATURES + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if 0 < y.sum() < len(y):
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = np.append(np.full(N_FEATURES, RIDGE * len(y)), 1e-9)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
    return mean, scale, w


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _prior_rows(groups: DataFrame, mean: float) -> float:
    """Pseudo-documents by the method of moments: mean (1 - mean) / variance between groups - 1, where that
    variance is what the means spread beyond the noise of their own documents. groups: n, s (sum), q (sum of
    squares), in UNITs."""
    m = F.col("s") / UNIT / F.col("n")
    noise = F.greatest(F.lit(0.0), F.col("q") / UNIT / F.col("n") - m * m) / F.col("n")
    row = groups.filter("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.pow(m - mean, 2) - noise)).alias("v")).first()
    spread = (row.v or 0.0) / row.n if row.n else 0.0
    if spread <= 0:
        return MOST_PRIOR
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, round(mean * (1 - mean) / spread - 1, 6))))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and keep of every row of docs.

    evidence is the classifier's probability of good quality from the whole text, score the posterior one, keep
    whether it is THRESHOLD or more. host and path default to the columns source and source/lang; nulls are a
    host or path of their own. A null text counts as empty. Repeated rows stay, and are evidence each. Posteriors
    of a site without other documents are the priors. Empty tables give no row.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    source = docs.select(F.col(id_col).alias("doc_id"), name(host).alias("host"), name(path).alias("path"), F.col(text).alias("text"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = model.value
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(3)]).reshape(batch.num_rows, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -14, 14)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.rint(p * UNIT).astype(np.int64))], names=["doc_id", "host", "path", "p"])

    kind = source.schema["doc_id"].dataType.simpleString()
    judged = Cut(source.mapInArrow(classify, f"doc_id {kind}, host string, path string, p long"), "quality").df
    sums = (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.round(F.col("p") * F.col("p") / UNIT).cast("long")).alias("q"))
    paths = Cut(judged.groupBy("host", "path").agg(*sums), "quality-paths").df
    hosts = Cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "quality-hosts").df
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total.s / UNIT + 0.5) / (total.n + 1) if total.n else 0.5
    host_rows, path_rows = _prior_rows(hosts, mean), _prior_rows(paths, mean)
    sites = paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    full = judged.join(sites, ["host", "path"])
    # a document is no evidence for its own site
    one = F.col("p") / UNIT
    above = (host_rows * mean + F.col("host_s") / UNIT - one) / (host_rows + F.col("host_n") - 1)
    site = (path_rows * F.col("host_posterior") + F.col("path_s") / UNIT - one) / (path_rows + F.col("path_n") - 1)
    full = full.withColumn("evidence", one).withColumn("host_posterior", above).withColumn("path_posterior", site)
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    full = full.withColumn("score", 1 / (1 + F.exp(-odds)))
    return full.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= THRESHOLD).alias("keep"))
