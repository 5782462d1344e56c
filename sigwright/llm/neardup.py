"""Near duplicates of whole documents (operator 1): a multi-index Hamming join over b-bit MinHash signatures.

A signature has SYMBOLS minima of 16 bits. Sets with the least similarity differ in more than ``far`` symbols
only with probability MISS. The symbols are split into far // 2 + 1 chunks: two signatures within that
distance differ, by the pigeonhole principle, in at most one symbol of some chunk. Each chunk is therefore
indexed once for each symbol that may be wrong, by the other ones: signatures within the distance share one
of these keys for certain. What shares a key is compared on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.llm.linking import active_buckets, linked_components
from sigwright.llm.shingles import GOLDEN, MinHasher, shingle_set
from sigwright.operators.components import connected_components
from sigwright.runtime import Cut, Owner, release_memory, release_shuffles

SYMBOLS = 48
MISS = 1e-6


def far_symbols(num: int, den: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The least distance that sets of similarity num / den exceed with probability miss at most."""
    p = 1 - num / den
    tail, d = 1.0, -1
    while tail > miss and d < symbols - 1:
        d += 1
        tail -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def chunk_keys(sigs: np.ndarray, far: int) -> np.ndarray:
    """rows x symbols keys: for each chunk and each of its symbols a hash of the chunk's other symbols."""
    n, symbols = sigs.shape
    wide = sigs.astype(np.uint64) + np.uint64(1)
    out = []
    for c, columns in enumerate(np.array_split(np.arange(symbols), min(symbols // 2, far // 2 + 1))):
        for wrong in columns:
            h = np.full(n, c * symbols + int(wrong) + 1, np.uint64)
            for column in columns:
                if column != wrong:
                    h = (h ^ (h >> np.uint64(31)) ^ wide[:, column]) * np.uint64(GOLDEN)
            out.append(h ^ (h >> np.uint64(29)))
    return np.stack(out, 1).view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    A document's set holds the distinct ``shingle``-word shingles of its whole text, A-Z lower-cased; with
    fewer words the whole sequence; without words, or with a null text, it is empty and linked with nothing.
    Sets with den * intersection >= num * union are linked, component_id is the smallest id reachable and kept
    says that it is the row's own. Ids name documents: rows with one id are one document, linked by any of its
    texts. A null id is linked with nothing, has a null component_id and is kept. Empty tables give no row;
    other columns are not read. Shingles are compared by 64-bit hashes.

    Equal sets are one node before anything is compared, so groups of copies cost one row. Texts of nodes that
    share a key are read a second time for their full sets.
    """
    far = far_symbols(num, den)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(SYMBOLS)
        for batch in batches:
            sizes, marks, sigs = [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), shingle)
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                sigs.append(hasher.symbols_of(hasher.minima(found))[0].tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.string()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "mark", "sig"])
        release_memory()

    signed = Cut(source.mapInArrow(sign, "doc_id long, n_shingles long, mark string, sig binary"), "signed").df
    nodes = Cut(signed.filter("mark IS NOT NULL AND doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("id"), F.max("sig").alias("sig")), "nodes").df

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint16).reshape(batch.num_rows, SYMBOLS)
                keys = chunk_keys(sigs, far)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                flat = keys.ravel()
                for at in range(0, len(flat), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 16)]), pa.array(ids[at : at + (1 << 16)])], names=["key", "id"])
        release_memory()

    keys = Cut(nodes.select("id", "sig").mapInArrow(keyed, "key long, id long"), "keys")
    buckets = Cut(active_buckets(keys.df), "buckets").df
    keys.drop()
    release_shuffles(docs.sparkSession)
    wanted = nodes.join(buckets.select("id").distinct(), "id").select("id", F.col("mark").alias("mark"))
    texts = source.join(wanted, source["doc_id"] == wanted["id"]).select("id", "mark", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(SYMBOLS)
        for batch in batches:
            rows = []
            for i, mark, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = shingle_set(value.as_py(), shingle)
                if len(found) and xxhash.xxh3_128_hexdigest(found.tobytes()) == mark:
                    rows.append((i, mark, found.view(np.int64), hasher.symbols_of(hasher.minima(found))[0].tobytes()))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["id", "mark", "set", "sig"])
        release_memory()

    sets = Cut(texts.mapInArrow(full, "id long, mark string, set array<long>, sig binary"), "sets").df
    if sets.groupBy("id", "mark").count().filter("count > 1").limit(1).count():  # rows that occur again
        sets = Cut(sets.dropDuplicates(["id", "mark"]), "sets").df
    roots = linked_components(buckets, sets, num, den, far)
    named = signed.join(nodes.select("mark", F.col("id").alias("node")), "mark", "left")
    # an id with several texts joins their nodes
    several = named.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("n > 1 AND lo <> hi")
    roots = Cut(roots, "near-roots").df
    if several.limit(1).count():
        extra = named.join(several.select("doc_id", "lo"), "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
        roots = connected_components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(extra), "a", "b").select(F.col("node").alias("id"), "root")
    placed = named.join(roots, named["node"] == roots["id"], "left")
    component = F.coalesce("root", "node", "doc_id")
    placed = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose document is the one of its group that stays: that with the smallest id.

    Of rows that share a kept id and a text one stays, whatever their other columns; texts that differ all stay,
    as they are one document. Rows with a null id stay.
    """
    # one look at the judgements serves both the documents that go and the ids with several rows, and nothing else is needed then
    with Owner() as owner:
        judged = near_duplicates(docs, id_col, text, **options).select("doc_id", "kept")
        marks = owner.keep(Cut(judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("NOT kept OR n > 1"), "near-marks")).df
    here = docs[id_col].cast("long")
    gone = marks.select(F.col("doc_id").alias("__gone"))
    single = docs.join(gone, here == gone["__gone"], "left_anti")
    several = marks.filter("kept AND n > 1").select(F.col("doc_id").alias("__again"))
    if not several.limit(1).count():
        return single
    return single.unionByName(docs.join(several, here == several["__again"], "left_semi").dropDuplicates([id_col, text]))


#: DuckDB SQL for op1: 3-word shingles, similarity 0.85.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
