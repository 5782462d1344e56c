import random

import pytest

from sigwright.operators import components
from sigwright.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.root for r in got.collect()} == brute([e for e in edges if None not in e])


def test_random_chain_star_and_cycles(spark):
    r = random.Random(1)
    check(spark, [(r.randrange(60), r.randrange(60)) for _ in range(45)])
    chain = list(range(40))
    r.shuffle(chain)
    check(spark, list(zip(chain, chain[1:])))
    check(spark, [(99, i) for i in range(30)] + [(7, 7), (200, 200), (1, None), (5, 6), (6, 5), (5, 6)])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 14])
def test_stars_take_no_round_and_paths_are_the_same_in_shuffles(spark, monkeypatch, sent):
    written = []

    class Counted(components.Cut):
        def __init__(self, df, name):
            written.append(name)
            super().__init__(df, name)

    monkeypatch.setattr(components, "Cut", Counted)
    monkeypatch.setattr(components, "SENT_NODES", sent)
    check(spark, [(i, 3) for i in range(3, 40)] + [(7, 3), (50, 41), (60, 60), (None, 2)])
    assert written == ["components", "components-low"]
    check(spark, [(9, 8), (8, 7), (7, 6), (6, 1), (20, 20), (30, 29), (30, 28), (28, 28)])
