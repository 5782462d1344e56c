"""Overlaps of genes where k-mers have a few owners or most genes."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigwright.operators import similarity
from sigwright.operators.components import connected_components
from sigwright.options import ClusterOptions

import model


def random_genes(seed, n=40):
    r = random.Random(seed)
    dna = lambda m: "".join(r.choice("ACGT") for _ in range(m))
    pool = [dna(30) for _ in range(6)] + ["A" * 40, "AC" * 20]
    out = {}
    for g in range(n):
        for t in range(r.randint(1, 3)):
            out[f"g{g:02}", t] = "".join(r.choice([dna(r.randint(5, 60)), r.choice(pool)]) for _ in range(r.randint(1, 4)))
    return out


def frame(spark, tx):
    return spark.createDataFrame([(g, t, f"{g}.{t}", s) for (g, t), s in tx.items()], "gid string, tidx int, tid string, seq string")


def plain_pairs(tx, samples, k):
    owned = defaultdict(set)
    for (g, _), s in tx.items():
        owned[g] |= {w for o in model.four(s) for w in model.windows(o, k)}
    per = defaultdict(Counter)
    for g, w in samples:
        per[g][w] += 1
    return {(a, b, d, per[a].total()) for a in per for b in owned if a != b and (d := sum(n for w, n in per[a].items() if w in owned[b]))}


def groups(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.root].add(r.node)
    return {frozenset(x) for x in out.values() if len(x) > 1}


@pytest.mark.parametrize("heavy", [0, 3, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_links_equal_a_loop(spark, seed, heavy):
    tx, k = random_genes(seed), 8
    df = frame(spark, tx)
    want = plain_pairs(tx, [tuple(r) for r in similarity.gene_samples(df, k).collect()], k)
    found = similarity.Overlaps(df, k, heavy=heavy)
    assert {tuple(r) for r in found.pairs().collect()} == want and len(want) > 100
    for threshold in (0.1, 0.35, 0.8):
        edges = spark.createDataFrame([(a, b) for a, b, d, n in want if d / n >= threshold], "src string, dst string")
        links = found.links(threshold)
        assert groups(connected_components(links).collect()) == groups(connected_components(edges).collect())


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_tiles_join_like_a_join(spark, tile):
    r = random.Random(4)
    one = spark.createDataFrame([("hot" if i < 20 else r.choice("abc"), i) for i in range(30)], "k string, x int")
    two = spark.createDataFrame([("hot" if i < 15 else r.choice("bcd"), i) for i in range(25)], "k string, y int")
    want = sorted(map(tuple, one.join(two, "k").select("k", "x", "y").collect()))
    assert sorted(map(tuple, similarity.tiled_join(one, two, "k", tile).select("k", "x", "y").collect())) == want


def test_twenty_thousand_genes_that_share_a_run(spark):
    """Every gene has the same run of A: 4 * 10**8 pairs, which clusters need not make; tiles of the join stay even."""
    own = F.translate(F.md5(F.concat(F.lit("x"), "id")), "0123456789abcdef", "ACGTACGTACGTACGT")
    tx = spark.range(20_000).select(F.format_string("g%05d", "id").alias("gid"), F.lit(0).alias("tidx"), F.concat(F.lit("t"), "id").alias("tid"), F.concat(F.lit("A" * 60), own).alias("seq"))
    found = similarity.Overlaps(tx, 20)
    assert found.heavy.count() < 200_000
    links = found.links()
    assert links.count() < 1_000_000
    roots = connected_components(links)
    assert roots.select("root").distinct().count() == 1 and roots.count() == 20_000
    few = tx.filter("gid < 'g01500'")
    pairs = similarity.Overlaps(few, 20).pairs()
    by_task = pairs.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert by_task.sum() == 1500 * 1499 and by_task.max() <= 5 * by_task.median()


def test_one_cluster_of_all_genes(spark):
    tx = spark.createDataFrame([(f"g{g:03}", t, f"{g}.{t}", "ACGT" * (g % 5)) for g in range(200) for t in range(1 + g % 3)], "gid string, tidx int, tid string, seq string")
    genes = spark.createDataFrame([(i, f"g{i:03}") for i in range(200)], "idx long, gid string")
    roots = spark.createDataFrame([(i, 0 if i % 50 else i) for i in range(200)], "idx long, root long")
    got = {(r.gid, r.tidx): r.tid for r in similarity.merged(tx, genes, roots).collect()}
    want, place = {}, Counter()
    for g in range(200):
        head = f"g{0 if g % 50 else g:03}"
        for t in range(1 + g % 3):
            want[head, place[head]] = f"{g}.{t}"
            place[head] += 1
    assert got == want


def test_empty_genes(spark):
    empty = frame(spark, {("a", 0): "", ("b", 0): "ACG"})
    found = similarity.Overlaps(empty, 8)
    assert found.pairs().collect() == [] and found.links().collect() == []
    genes = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, gid string")
    assert similarity.cluster_transcripts(empty, genes, ClusterOptions(k=8)).count() == 2


@pytest.mark.parametrize("k", [5, 12, 33])
def test_overlaps_of_sequences_with_other_letters(spark, k):
    r = random.Random(k)
    pool = ["".join(r.choice("ACGTNaé" if i % 2 else "ACGT") for _ in range(60)) for i in range(8)]
    tx = {(f"g{g:02}", t): "".join(r.choices(pool, k=2)) + "ACGT"[g % 4] for g in range(20) for t in range(2)}
    df = frame(spark, tx)
    want = plain_pairs(tx, [tuple(x) for x in similarity.gene_samples(df, k).collect()], k)
    for heavy in (2, similarity.HEAVY):
        assert {tuple(x) for x in similarity.Overlaps(df, k, heavy=heavy).pairs().collect()} == want and want


def test_many_owners_stay_packed(spark):
    """k-mers of 200 genes are joined in tasks: no vector of a gene is gathered for them."""
    r = random.Random(9)
    shared = "".join(r.choice("ACGT") for _ in range(80))
    found = similarity.Overlaps(frame(spark, {(f"g{g:03}", 0): shared for g in range(200)}), 12)
    assert found.vectors.count() == 0 and found.pairs().count() == 200 * 199
