import random
import time
from itertools import combinations

import numpy as np
import pytest

from sigwright.llm import linking, neardup
from sigwright.llm.queries import ORACLES, QUERIES

from oracle import same_rows


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus(seed, groups=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 5, 30]) if g else 60):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((i, r.choice([" ", "\n", "\t  "]).join(x.upper() if r.random() < 0.1 else x for x in own)))
            i += r.randint(1, 3)
    return rows


@pytest.mark.parametrize("n,num,den,seed", [(3, 85, 100, 1), (5, 80, 100, 2), (3, 85, 100, 3)])
def test_equals_brute_force(documents, n, num, den, seed, monkeypatch):
    monkeypatch.setattr(linking, "SET_BLOCK", 16)
    monkeypatch.setattr(linking, "SIG_BLOCK", 16)
    rows = corpus(seed)
    got = neardup.near_duplicates(documents(rows, extra=True).repartition(5), shingle=n, num=num, den=den).collect()
    want = brute(rows, n, num, den)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, n)) for i, t in rows}


def test_odd_rows(documents):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one  two"), (None, "one"), (9, long), (10, long + " z"), (11, "one"), (11, "one"), (12, "Été x y"), (13, "été x y")]
    got = neardup.near_duplicates(documents(rows), shingle=3, num=85, den=100).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by == {
        1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 7, True), 8: (1, 6, False), None: (1, None, True),
        9: (29_998, 9, True), 10: (29_999, 9, False), 11: (1, 4, False), 12: (1, 12, True), 13: (1, 13, True),
    }


def test_an_id_with_several_texts_joins_their_groups(documents):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = neardup.near_duplicates(documents([(1, a), (5, a), (5, b), (7, b)])).collect()
    assert {r.component_id for r in got} == {1}


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_first_of_each_keeps_one(documents):
    text = " ".join(f"a{i}" for i in range(20))
    rows = documents([(3, text), (1, text), (2, "other words entirely here now"), (None, text)])
    assert sorted((r.doc_id or 0) for r in neardup.first_of_each(rows).collect()) == [0, 1, 2]


def test_signatures_within_the_distance_share_a_key():
    r = np.random.default_rng(2)
    for far in (neardup.far_symbols(85, 100), neardup.far_symbols(80, 100), 1, 7):
        for _ in range(50):
            a = r.integers(0, 1 << 16, neardup.SYMBOLS, dtype=np.uint16)
            b = a.copy()
            at = r.choice(neardup.SYMBOLS, far, replace=False)
            b[at] ^= 1
            ka, kb = neardup.chunk_keys(np.stack([a, b]), far)
            assert set(ka.tolist()) & set(kb.tolist())


def test_distance_covers_the_similarity():
    d = neardup.far_symbols(85, 100)
    r = np.random.default_rng(3)
    assert (r.binomial(neardup.SYMBOLS, 0.15, 200_000) > d).mean() < 1e-4 and d < neardup.SYMBOLS // 2


def test_signatures_of_real_texts_stay_within_the_distance():
    """The minima themselves, not a model of them: pairs of similarity 0.85 to 0.9 that the distance would lose."""
    r = np.random.default_rng(4)
    hasher, far = neardup.MinHasher(neardup.SYMBOLS), neardup.far_symbols(85, 100)
    lost = pairs = 0
    for _ in range(4000):
        n = int(r.integers(40, 200))
        swapped = int(n * r.uniform(0.053, 0.081))
        words = [f"w{x}" for x in r.integers(0, 1 << 40, n + swapped)]
        one, two = (np.unique(np.array([hash_of(w) for w in x], np.uint64)) for x in (words[:n], words[swapped:]))
        both = len(np.intersect1d(one, two))
        if 100 * both >= 85 * (len(one) + len(two) - both):
            pairs += 1
            a, b = (hasher.symbols_of(hasher.minima(x))[0] for x in (one, two))
            lost += (a != b).sum() > far or not set(neardup.chunk_keys(a[None], far)[0].tolist()) & set(neardup.chunk_keys(b[None], far)[0].tolist())
    assert pairs > 3000 and lost == 0


def hash_of(word):
    return int(neardup.xxhash.xxh3_64_intdigest(word))


def test_repeated_rows_cost_no_squares(documents):
    words = [f"a{i}" for i in range(120)]
    one, two = " ".join(words), " ".join([*words[:60], "new", *words[61:]])
    few = documents([(1, one), (2, two)])
    neardup.near_duplicates(few).collect()
    began = time.time()
    assert {r.component_id for r in neardup.near_duplicates(few).collect()} == {1}
    base = time.time() - began
    many = documents([(1, one), (2, two)] * 3000).repartition(4)
    began = time.time()
    got = neardup.near_duplicates(many).collect()
    assert time.time() - began < base + 15 and len(got) == 6000 and {r.component_id for r in got} == {1}


def test_first_of_each_keeps_repeated_rows_once(documents):
    text, other = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = neardup.first_of_each(documents([(1, text)] * 3 + [(2, text)] * 2 + [(1, other), (3, None), (3, None), (None, "x"), (None, "x")])).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == sorted([(1, text), (1, other), (3, ""), (0, "x"), (0, "x")])


def test_query_equals_sql(spark, small):
    same_rows(QUERIES["op1_neardup"](spark, small), ORACLES["op1_neardup"], small)
