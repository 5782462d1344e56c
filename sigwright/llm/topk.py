"""Exact top-k by inner product (operator 5): products of query tiles and shards, merged as a tree.

Vectors are packed into blocks of a fixed number of rows. Each (query tile, shard) pair meets in one row of a
join on both numbers and is scored as one matrix product; only a tile's k best per query leave it, and lists
of a query are merged in rounds of FAN lists. Memory holds one tile of scores; nothing is broadcast and no
list of a query gathers in one place before it is cut to k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.runtime import Cut

#: Queries of a tile and rows of a shard; a shard is sent once for each tile. Scores are made STEP rows at a time.
TILE = 4096
SHARD = 4096
STEP = 1024
FAN = 16
SCALE = 256
#: Integers up to here are exact in double arithmetic.
EXACT = 1 << 53
#: Scores are held within the range of a long.
LIMIT = float(1 << 63)
#: Types that blocks are sent in, by code: the first that holds all components.
KINDS = (np.int16, np.float32, np.float64)


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<double>) with floor(scale * x) for each x; rows with a null id, a null vector, or a null or
    non-finite component, before or after scaling, are left out. Rows that occur again stay."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    # the product is taken in doubles: floor() of a large one would not fit a long
    v = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale))
    return rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)


def _packed(vectors: DataFrame, rows: int, others: int, me: str, other: str) -> DataFrame:
    """Blocks of about ``rows`` vectors of one dimension, each repeated for every block of the other side.

    Rows of a block share a hash of their id; columns: me, other (numbers), dim, ids, data.
    """
    blocks = max(1, -(-vectors.count() // rows))
    kept = vectors.withColumn(me, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, me)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}

        def full(key) -> pa.RecordBatch:
            ids, data = zip(*waiting.pop(key), strict=True)
            kind, block = narrowed(np.concatenate(data))
            heads = [pa.array([x], pa.int32()) for x in (*key, kind)]
            return pa.RecordBatch.from_arrays([*heads, pa.array([np.array(ids, np.int64).tobytes()]), pa.array([block])], names=[me, "dim", "kind", "ids", "data"])

        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            for i, key, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends[:-1], ends[1:], strict=True):
                waiting.setdefault((key, int(b - a)), []).append((i, flat[a:b].copy()))
                if len(waiting[key, int(b - a)]) >= rows:
                    yield full((key, int(b - a)))
        for key in list(waiting):
            yield full(key)

    packed = kept.mapInArrow(pack, f"{me} int, dim int, kind int, ids binary, data binary")
    return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def narrowed(flat: np.ndarray) -> tuple[int, bytes]:
    """Code of the smallest of KINDS that holds whole numbers exactly, and the numbers in it."""
    most = np.abs(flat).max(initial=0)
    kind = 0 if most < 1 << 15 else 1 if most <= 1 << 24 else 2
    return kind, flat.astype(KINDS[kind]).tobytes()


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows but its own, ties to the smaller row id.

    Products in doubles are exact while they and their sums stay below EXACT. Beyond, they are within a known
    distance of the integer, and only rows that may be among the k best are computed again as integers. Scores
    outside the range of a long are held at its ends, and tie there.
    """
    none = np.zeros(0, np.int64)
    if not len(queries) or not len(rows):
        return none, none, none
    scores = queries @ rows.T
    own = query_ids[:, None] == row_ids[None, :]
    scores[own] = -np.inf
    take = min(k, scores.shape[1])
    size = np.abs(queries).max(1, initial=0)[:, None] * np.abs(rows).sum(1)[None, :]
    odd = size >= EXACT
    if not odd.any():
        least = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
        at, col = np.nonzero((scores >= least[:, None]) & ~own)
        found = scores[at, col]
        order = np.lexsort((row_ids[col], -found, at))
        at, col, found = at[order], col[order], found[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        return query_ids[at[keep]], row_ids[col[keep]], found[keep].astype(np.int64)
    miss = np.where(odd, size * (queries.shape[1] + 2) * 2.0**-52, 0.0)
    low, high = (np.clip(x, -LIMIT, LIMIT) for x in (scores - miss, scores + miss))
    low[own] = -np.inf
    least = np.partition(low, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
    at, col = np.nonzero((high >= least[:, None]) & ~own)
    starts = np.searchsorted(at, np.arange(len(queries) + 1))
    out: list[tuple[int, int, int]] = []
    for i in range(len(queries)):
        mine = col[starts[i] : starts[i + 1]]
        known = low[i, mine] == high[i, mine]
        whole = None if known.all() else list(map(int, queries[i].tolist()))
        exact = [int(scores[i, j]) if sure else sum(a * int(b) for a, b in zip(whole, rows[j].tolist(), strict=True)) for j, sure in zip(mine.tolist(), known.tolist(), strict=True)]
        ranked = sorted((-_long(s), int(r)) for s, r in zip(exact, row_ids[mine].tolist(), strict=True))[:k]
        out += [(int(query_ids[i]), r, -s) for s, r in ranked]
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


def best_of_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best`` over any number of rows, in steps, each query's lists cut to k."""
    lists = [best(queries, query_ids, rows[at : at + step], row_ids[at : at + step], k) for at in range(0, len(rows), step)]
    query, row, score = (np.concatenate([x[c] for x in lists]) for c in range(3))
    order = np.lexsort((row, ~score, query))
    query, row, score = query[order], row[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], score[keep]


def _long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, tile: int = TILE, shard: int = SHARD
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best other rows by integer inner product.

    Components are floor(scale * x) with x as double. Ties go to the smaller vec_id; a query with fewer than k
    other rows has all of them. Vectors that are null, hold a null or a non-finite component, or have no id
    take no part; vectors of different length are not compared. Rows with the query's own id are not its
    candidates. Ids that occur again are candidates as often as they occur, and a repeated query id is one
    query, the one with the largest vector. Scores outside the range of a long are held at its ends. Empty
    tables give no row.
    """
    spark = rows.sparkSession
    vectors = Cut(whole_vectors(rows, id_col, vector, scale), "topk").df
    asked = Cut(whole_vectors(rows.filter(is_query), id_col, vector, scale).groupBy("id").agg(F.max("v").alias("v")), "topk-queries").df
    tiles = max(1, -(-asked.count() // tile))
    shards = max(1, -(-vectors.count() // shard))
    left = _packed(asked, tile, shards, "t", "s").select("t", "s", "dim", F.col("kind").alias("qkind"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    right = _packed(vectors, shard, tiles, "s", "t")
    n = max(1, min(tiles * shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = left.repartition(n, "t", "s", "dim").join(right.repartition(n, "t", "s", "dim"), ["t", "s", "dim"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, dim, qkind, qids, qdata, kind, ids, data in zip(*(batch.column(i) for i in range(8)), strict=True):
                d = dim.as_py()
                q, r = (np.frombuffer(x.as_buffer(), np.int64) for x in (qids, ids))
                a, b = (np.frombuffer(x.as_buffer(), KINDS[code.as_py()]).astype(np.float64).reshape(len(i), d) for code, x, i in ((qkind, qdata, q), (kind, data, r)))
                found = best_of_shard(a, q, b, r, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), s.as_py(), np.int32)), *map(pa.array, found)], names=["s", "query_id", "vec_id", "score"])

    lists = met.select("s", "dim", "qkind", "qids", "qdata", "kind", "ids", "data").mapInArrow(score, "s int, query_id long, vec_id long, score long")
    order = (F.col("score").desc(), F.col("vec_id"))
    while shards > FAN:
        lists = lists.withColumn("s", F.floor(F.col("s") / FAN).cast("int"))
        rank = F.row_number().over(Window.partitionBy("query_id", "s").orderBy(*order))
        lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for op5: queries are the rows whose vec_id is divisible by 50.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""
