from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigwright.llm import mixing
from sigwright.llm.queries import ORACLES, QUERIES

from oracle import same_rows


def levels(sizes, weights=(5, 2, 1)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def rows_of(n=200):
    out = [(i, " ".join(["w"] * (i * 7 % 23)), ["b", "a", None, "c", "\U0001f600", "ﬁ"][i % 6 if i % 3 else 0]) for i in range(n)]
    return [*out, (None, "x y", "a"), (3, None, "a"), (7, "", "zero"), (8, "w w", "a"), (8, "w w", "a")]


@pytest.mark.parametrize("range_rows", [4, 20_000])
def test_budgets_are_met(documents, range_rows):
    rows = rows_of()
    got = mixing.mix(documents(rows, extra=True).repartition(7), range_rows=range_rows).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert target == pytest.approx(levels(sizes)) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(documents(rows[::-1]).repartition(3), range_rows=20_000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_materialised_words_follow_the_mix(documents):
    rows = [(i, f" {'a b  c'[: 1 + i % 6]}\n" + " ".join(f"v{i}.{k}" for k in range(i % 31)), "abc"[i % 3]) for i in range(90)]
    df = documents(rows, extra=True)
    out = mixing.materialise(df, range_rows=5)
    assert out.columns == df.columns
    want = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df).collect()}
    texts, words = dict((i, t) for i, t, _ in rows), defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
    assert dict(words) == {i: taken for i, (size, taken) in want.items() if taken}


def test_empty_and_wordless(documents):
    assert mixing.mix(documents([])).count() == 0 and mixing.materialise(documents([])).count() == 0
    got = mixing.mix(documents([(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_words(spark):
    cases = {"a b": 2, "": 0, None: 0, "\x0b a\x0c\r\nb\t": 2, "a b\x1cc": 1, "é": 1}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, n int")
    assert df.filter(mixing.words(F.col("x")) != F.col("n")).count() == 0


def test_query_equals_sql(spark, small):
    same_rows(QUERIES["op6_mixing"](spark, small), ORACLES["op6_mixing"], small)


def test_many_documents_without_an_id_are_many_ranges(documents):
    rows = [(None if i % 3 else i, " ".join(f"w{i}.{k}" for k in range(i * 13 % 40)), "hot" if i % 7 else "cold") for i in range(1200)] + [(None, "one text", "hot")] * 30
    df = documents(rows).repartition(6)
    sized = mixing._keyed(df, "doc_id", "text", "source")
    spans = mixing._spans(sized, 20)(sized).groupBy("name", "span").count().toPandas()["count"]
    assert spans.max() <= 100 and len(spans) > 30
    assert Counter(map(tuple, mixing.mix(df, range_rows=20).collect())) == Counter(map(tuple, mixing.mix(df).collect()))
    few, many = (Counter(map(tuple, mixing.materialise(df, range_rows=n).collect())) for n in (20, 20_000))
    assert few == many
