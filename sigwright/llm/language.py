"""Language identification by words, backing off to character n-grams (operator 11).

A word is a letter and all letters and marks that follow, lower-cased. A word that the model knows costs, in each language,
minus the decimal logarithm of its frequency there; where a language lacks it, a fixed penalty. A word that no
language knows is looked up as its character n-grams, framed by blanks: those of five characters, and with none
of these known those of four, and so on. Of the longest that are known the mean cost counts. A text costs the
mean of its words, and the cheapest language is predicted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.llm.shingles import text_slices
from sigwright.runtime import Cut, release_memory

#: Bound of the sample that the model learns from, in documents, shared out among the languages.
SAMPLE_ROWS = 8000
#: Languages that can be learnt, those with most documents.
LANGUAGES = 256
#: Entries of the model, shared out among the languages: words, and n-grams of each length.
WORDS = 160_000
GRAMS = 60_000
LONGEST = 5
#: The cost of what a language lacks, as a negative decimal logarithm.
PENALTY = 7.0
#: Costs of words are whole numbers of these parts: sums are exact and don't depend on the order of words.
PARTS = 1_000_000
UNKNOWN = "und"
#: Costs of words that a task keeps, in numbers.
CACHE_NUMBERS = 1 << 21

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII_WORD = regex.compile(r"[a-z]+")


def held_out(id_col: str) -> Column:
    """Whether an id is in the fold that is never learnt from: crc32 of its text mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of the words, framed by blanks; the word each belongs to). Single characters have no frame."""
    frame = " " if n > 1 else ""
    chars = np.frombuffer("".join([f"{frame}{w}{frame}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2 * len(frame)
    counts = np.maximum(lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), counts)
    at = np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(n):
        h = (h ^ chars[at + i]) * np.uint64(0x100000001B3D4E5F)
        h ^= h >> np.uint64(31)
    return h, owner


@dataclass
class Level:
    """Costs by key: key i has the languages lang[first[i]:first[i + 1]] and their savings against the penalty."""

    key: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    saving: np.ndarray

    def add(self, keys: np.ndarray, owner: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Adds the savings of known keys to the rows of their owners; returns how many keys each row has known."""
        if not len(self.key) or not len(keys):
            return np.zeros(len(sums), np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        known = self.key[at] == keys
        at, owner = at[known], owner[known]
        counts = self.first[at + 1] - self.first[at]
        entry = np.arange(counts.sum()) + np.repeat(self.first[at] - (np.cumsum(counts) - counts), counts)
        flat = np.repeat(owner, counts) * sums.shape[1] + self.lang[entry]
        sums += np.bincount(flat, self.saving[entry], sums.size).reshape(sums.shape)
        return np.bincount(owner, minlength=len(sums))


@dataclass
class LanguageModel:
    """langs in ascending order; levels[0] are words, levels[n] n-grams; usual: the language with most documents."""

    langs: list[str]
    levels: list[Level]
    usual: int

    def costs(self, words: list[str]) -> np.ndarray:
        """The costs of words in PARTS, words x languages; what is not known at all costs the penalty everywhere."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.flatnonzero(self.levels[0].add(word_keys(words), np.arange(len(words)), out) == 0)
        for n in range(len(self.levels) - 1, 0, -1):
            if not len(left):
                break
            sums = np.zeros((len(left), len(self.langs)))
            known = self.levels[n].add(*gram_keys([words[i] for i in left], n), sums)
            out[left] = sums / np.maximum(known, 1)[:, None]
            left = left[known == 0]
        return np.rint((PENALTY - out) * PARTS).astype(np.int64)


class Scorer:
    """Predicts texts with a model and remembers the costs of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.most = CACHE_NUMBERS // max(1, len(model.langs))
        self.slots: dict[str, int] = {}
        self.costs = np.zeros((0, len(model.langs)), np.int64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; score: the share of the language when costs are read as probabilities."""
        out, fresh = [], []
        counted = [Counter(words_of(t)) for t in texts]
        if len(self.slots) > self.most:
            self.slots, self.costs = {}, self.costs[:0]
        for words in counted:
            for w in words:
                if w not in self.slots:
                    self.slots[w] = len(self.slots)
                    fresh.append(w)
        if self.model.langs and fresh:
            step = max(1, (1 << 20) // len(self.model.langs))
            self.costs = np.concatenate([self.costs, *(self.model.costs(fresh[i : i + step]) for i in range(0, len(fresh), step))])
        for words in counted:
            if not words or not self.model.langs:
                out.append((UNKNOWN, 0.0))
                continue
            slots = np.fromiter((self.slots[w] for w in words), np.int64, len(words))
            times = np.fromiter(words.values(), np.int64, len(words))
            cost = times @ self.costs[slots] / (int(times.sum()) * PARTS)
            best = int(cost.argmin())
            if cost[self.model.usual] <= cost[best]:
                best = self.model.usual
            share = np.exp(-np.log(10) * (cost - cost[best]))
            out.append((self.model.langs[best], float(share[best] / share.sum())))
        return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, dict[str, int]]:
    """((lang, text) of at most ``rows`` documents outside the held-out fold, documents by language). Each language has
    an equal part, or all it has: its documents with the smallest hashes of their ids.

    Rows with a null id, text or lang are left out; an id that occurs again counts once. What reaches the driver is
    one number for each of at most LANGUAGES languages. Hashes cut a language down before it is sorted, so that
    no task sorts all documents of one language.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    each = max(1, rows // max(1, len(counts)))
    spark = docs.sparkSession
    # twice as many as are needed, and some: hashes spread unevenly
    shares = spark.createDataFrame([(k, min(1.0, (2 * each + 50) / n)) for k, n in counts.items()], "lang string, share double")
    mark = F.xxhash64("id", F.lit(11))
    drawn = known.select("id", "lang").join(F.broadcast(shares), "lang").filter((mark.cast("double") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    ranked = drawn.select("id", "lang").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(mark, "id")))
    chosen = ranked.filter(F.col("rank") <= each).select("id", "lang")
    return known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.max("text").alias("text")).select("lang", "text"), counts


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """The model of a bounded sample of documents (see ``sample``). words, grams: entries that it keeps, those that
    are most frequent in their language. Without a row to learn from it knows no language."""
    rows, counts = sample(docs, sample_rows, id_col, text, lang)
    if not counts:
        return LanguageModel([], [], 0)
    langs = sorted(counts)
    number = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            seen: dict[str, Counter] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(name, Counter()).update(words_of(value.as_py()))
            for name, found in seen.items():
                own, times = list(found), np.fromiter(found.values(), np.int64, len(found))
                for n in range(LONGEST + 1):
                    keys, owner = (word_keys(own), np.arange(len(own))) if n == 0 else gram_keys(own, n)
                    key, at = np.unique(keys, return_inverse=True)
                    total = np.bincount(at, times[owner], len(key)).astype(np.int64)
                    size = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n, np.int32)), pa.array(np.full(size, number[name], np.int32)), pa.array(key.view(np.int64)), pa.array(total)], names=["n", "lang", "key", "seen"])
        release_memory()

    # texts of a bounded sample: few partitions, so that words are counted together
    counted = Cut(rows.repartition(24).mapInArrow(count, "n int, lang int, key long, seen long").groupBy("n", "lang", "key").agg(F.sum("seen").alias("seen")), "language-counts")
    totals = {(r.n, r.lang): r.total for r in counted.df.groupBy("n", "lang").agg(F.sum("seen").alias("total")).collect()}
    most = F.when(F.col("n") == 0, words // len(langs) + 1).otherwise(grams // len(langs) + 1)
    order = Window.partitionBy("n", "lang").orderBy(F.desc("seen"), "key")
    kept = counted.df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank").toPandas()
    counted.drop()
    levels = []
    for n in range(LONGEST + 1):
        rows_n = kept[kept.n == n]
        keys, lang_of, times = rows_n.key.to_numpy(np.int64).view(np.uint64), rows_n.lang.to_numpy(np.int64), rows_n.seen.to_numpy(float)
        order = np.lexsort((lang_of, keys))
        keys, lang_of, times = keys[order], lang_of[order], times[order]
        whole = np.array([totals.get((n, i), 1) for i in range(len(langs))], float)
        key, first = np.unique(keys, return_index=True)
        levels.append(Level(key, np.append(first, len(keys)), lang_of, np.maximum(PENALTY + np.log10(times / whole[lang_of]), 0.01)))
    usual = min(range(len(langs)), key=lambda i: (-counts[langs[i]], langs[i]))
    return LanguageModel(langs, levels, usual)


def label_documents(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of docs, the predicted language of each whole text and its score, 0 to 1.

    A null text, or one without a letter, has the language ``und`` and the score 0, as has every text where the model
    knows no language. Where languages cost the same, the one with most documents wins, then the first by code
    points. The model (bounded by WORDS and GRAMS, about 10 MB) is broadcast; rows are independent, so
    there is no shuffle. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in text_slices(batches, len(keep)):
            found = scorer.predict(batch.column(len(keep)).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *outputs])
        release_memory()

    fields = "".join(f"`{k}` {source.schema[i].dataType.simpleString()}, " for i, k in enumerate(keep))
    return source.mapInArrow(run, f"{fields}`{outputs[0]}` string, `{outputs[1]}` double")


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, learnt from their own lang outside the fold."""
    return label_documents(docs.withColumn("held_out", held_out("doc_id")), fit(docs), keep=("doc_id", "held_out"))
