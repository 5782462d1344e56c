import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwright.llm import topk
from sigwright.llm.queries import ORACLES, QUERIES

from oracle import same_rows

KIND = "vec_id long, embedding array<float>, id string, score string, s string"


def brute(rows, is_query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if is_query(i):
            asked[i] = max(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], KIND)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k, **options)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("tile,shard", [(4, 3), (7, 2), (1024, 4096)])
def test_equals_brute_force(spark, tile, shard):
    r = random.Random(tile)
    rows = [(i, [r.choice([-1.0, -0.5, 0.25, 0.3, 1.0]) for _ in range(3)]) for i in range(60)]
    assert run(spark, rows, tile=tile, shard=shard) == brute(rows, lambda i: i % 3 == 0, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (10, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (0, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 5.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)


def test_one_large_vector_costs_little():
    r = np.random.default_rng(1)
    queries, rows = (r.integers(-256, 256, (n, 32)).astype(float) for n in (256, 1024))
    began = time.time()
    plain = topk.best(queries, np.arange(256), rows, np.arange(1000, 2024), 5)
    base = time.time() - began
    rows[7, 3] = 2.0**70
    began = time.time()
    got = topk.best(queries, np.arange(256), rows, np.arange(1000, 2024), 5)
    assert time.time() - began < 20 * base + 0.5
    for q in range(256):
        mine = [(int(row), int(s)) for i, row, s in zip(*got, strict=True) if i == q]
        exact = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(queries[q], x, strict=True)))), i) for i, x in enumerate(rows))[:5] if q < 4 else None
        assert len(mine) == 5 and (exact is None or mine == [(1000 + i, -s) for s, i in exact])
    assert len(plain[0]) == len(got[0]) == 5 * 256


def test_all_large_vectors_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.choice([1e20, -3e20, 7e19, 1.5, 1e20 + 1e13]))) for _ in range(3)]) for i in range(25)]
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    want = []
    for q in range(0, 25, 3):
        found = sorted((-held(sum(a * b for a, b in zip(whole[q], w))), i) for i, w in enumerate(whole) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert run(spark, rows, tile=8, shard=32) == want and {s for *_, s in want} == {(1 << 63) - 1}
    rows = [(i, [float(np.float32(r.choice([3e6, -3e6 + 1, 7e5, 1.5, 2999999.75]))) for _ in range(40)]) for i in range(25)]
    assert run(spark, rows, tile=8, shard=32) == brute(rows, lambda i: i % 3 == 0, 5)


def test_many_ties_go_to_small_ids(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)]
    assert run(spark, rows, tile=8, shard=8) == brute(rows, lambda i: i % 3 == 0, 5)


def test_query_equals_sql(spark, small):
    same_rows(QUERIES["op5_topk"](spark, small), ORACLES["op5_topk"], small)
