"""The stages against a plain model, and properties of their results."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwright.operators import count, estimate, index, kmers, select, similarity
from sigwright.options import ClusterOptions, EstimateOptions, SelectOptions
from sigwright.plans.stages import build_keys, quantify
from sigwright.sources import text

import model

K, M = 6, 10


def make(seed, genes=6):
    r = random.Random(seed)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared = dna(40)
    tx = {}
    for g in range(genes):
        common = dna(90)
        for t in range(r.randint(1, 3)):
            parts = [common, dna(r.randint(0, 120))] + [shared] * (r.random() < 0.4)
            r.shuffle(parts)
            tx[f"G{g}", t] = "".join(parts)
    tx["short", 0] = dna(K)
    tx["one", 0] = dna(K + 1)
    tx["empty", 0] = ""
    tx["poly", 0] = "A" * 60
    return tx


def frame(spark, tx):
    return spark.createDataFrame([(g, t, f"{g}.{t}", s) for (g, t), s in tx.items()], "gid string, tidx int, tid string, seq string")


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_equal_the_model(spark, seed):
    tx = make(seed)
    df = frame(spark, tx)
    regs = model.regions(tx, K)
    found = index.signature_regions(df, K)
    assert sorted((r.gid, r.tidx, r.position, r.seq) for r in found.collect()) == sorted(regs)
    ks = model.keys(tx, regs, K, M)
    keys = select.selected_keys(found, K, M)
    assert {tuple(r) for r in keys.collect()} == ks
    pos = select.key_positions(found, keys, K)
    assert Counter(tuple(r) for r in pos.select("gid", "key", "tidx", "position").collect()) == model.positions(regs, ks, K)
    r = random.Random(seed)
    reads = []
    for _ in range(200):
        s = r.choice(list(tx.values()))
        at = r.randrange(max(1, len(s) - 30))
        reads.append(r.choice(model.four(s[at : at + 40])).replace("CG", r.choice(["CG", "CN"]), 1))
    got = count.key_counts(keys, spark.createDataFrame([(x,) for x in reads], "seq string"), K)
    assert {(x.gid, x.key): x["count"] for x in got.collect()} == model.counts(ks, reads, K)


def test_partitioning_does_not_change_results(spark):
    df = frame(spark, make(3))
    one = {tuple(r) for r in index.signature_regions(df.repartition(1), K).collect()}
    assert one == {tuple(r) for r in index.signature_regions(df.repartition(7), K).collect()}


def test_orientations_leave_out_their_own_last_window(spark):
    df = spark.createDataFrame([("g", 0, "t", "AACCG")], "gid string, tidx int, tid string, seq string")
    got = {r.kmer for r in kmers.gene_kmers(df, 3).collect()}
    assert got == {w for o in model.four("AACCG") for w in model.windows(o, 3)}
    assert "CCG" not in got and "CGG" in got


def test_repeats_in_a_homopolymer_and_palindromes_count_twice(spark):
    keys = spark.createDataFrame([("g", "AAAA"), ("g", "ACGT"), ("g", "ACGG")], "gid string, key string")
    reads = spark.createDataFrame([("AAAAA",), ("ACGT",), ("ACGG",), (None,), ("",), ("NNNN",), ("ACNGT",)], "seq string")
    got = {r.key: r["count"] for r in count.key_counts(keys, reads, 4).collect()}
    assert got == {"AAAA": 4, "ACGT": 2, "ACGG": 1}


def test_plain_pattern_counts(spark):
    patterns = spark.createDataFrame([("ATCG",), ("CGAT",), ("AAAA",), ("TTTT",)], "kmer string")
    got = count.exact_counts(patterns, spark.createDataFrame([("ATCG" * 6,)], "seq string"), 4)
    assert {r.kmer: r.n for r in got.collect()} == {"ATCG": 6, "CGAT": 5, "AAAA": 0, "TTTT": 0}


def test_clusters_merge_in_record_order(spark):
    a, b, c = "ACGTTGCAAGGCTTACCGTA" * 3, "TTGACCATGGCAATCCGGAT" * 3, "GGGTCTAGAACATTTGCCCA" * 3
    tx = frame(spark, {("z", 0): a, ("m", 0): a + b, ("k", 0): b, ("q", 0): c})
    genes = spark.createDataFrame([(0, "z"), (1, "m"), (2, "k"), (3, "q")], "idx long, gid string")
    out = similarity.cluster_transcripts(tx, genes, ClusterOptions(k=12))
    assert sorted((r.gid, r.tidx, r.tid) for r in out.collect()) == [("q", 0, "q.0"), ("z", 0, "z.0"), ("z", 1, "m.0"), ("z", 2, "k.0")]


def test_threshold_counts_itself(spark):
    pairs = spark.createDataFrame([("a", "b", 2, 20), ("b", "a", 1, 20), ("c", "d", 1, 20)], "gid1 string, gid2 string, dup long, total long")
    assert [tuple(r) for r in similarity.similarity_edges(pairs, 0.1).collect()] == [("a", "b")]


def test_expectation_maximisation_conserves_counts():
    r = np.random.default_rng(5)
    w = r.integers(0, 3, (9, 4)).astype(float)
    w[0] = 0
    c, o = r.integers(0, 50, 9).astype(float), r.integers(1, 5, 9).astype(float)
    density, share, rounds = estimate.expectation_maximisation(w, c, o)
    assert density @ (o @ w) == pytest.approx(c[w.any(1)].sum())
    assert share.sum() == pytest.approx(1) and rounds > 1
    again, _, fewer = estimate.expectation_maximisation(w, c, o, start=density * (o @ w) / c[w.any(1)].sum())
    assert again == pytest.approx(density, abs=1e-6) and fewer <= rounds


def test_abundance_sums_to_a_million(spark):
    tx = make(4)
    df = frame(spark, tx)
    built = build_keys(df, SelectOptions(12, M))
    reads = spark.createDataFrame([(s[i : i + 40],) for s in tx.values() for i in range(0, max(0, len(s) - 40), 3)], "seq string")
    rows = quantify(built, reads, EstimateOptions(k=12, read_length=40))
    assert rows.agg(F.sum("tpm")).first()[0] == pytest.approx(1e6)
    assert rows.count() == len(tx)
    nothing = quantify(built, spark.createDataFrame([], "seq string"), EstimateOptions(k=12, read_length=40))
    assert nothing.agg(F.sum("tpm"), F.sum("est_reads")).first() == (0, 0)


def test_small_abundances_count_as_none(spark):
    tx = spark.createDataFrame([("g", 0, "t", "A" * 100), ("g", 1, "u", "A" * 100)], "gid string, tidx int, tid string, seq string")
    got = estimate.abundance(tx, spark.createDataFrame([("g", 0, 0.00099), ("g", 1, 0.001)], "gid string, tidx int, density double"), EstimateOptions(k=40, read_length=100))
    assert {r.tid: r.est_reads > 0 for r in got.collect()} == {"t": False, "u": True}


def test_numbered_genes(spark):
    assert [tuple(r) for r in text.numbered_genes(frame(spark, {("b", 0): "", ("a", 0): "", ("b", 1): ""})).orderBy("idx").collect()] == [(0, "a"), (1, "b")]
