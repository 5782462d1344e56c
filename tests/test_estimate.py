"""Estimates on sparse classes: genes of any size, coverage, and state that follows a stream."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwright.operators import count, estimate, index, select
from sigwright.options import EstimateOptions
from sigwright.streaming.batches import BatchWriter, Staged, latest
from sigwright.streaming.counts import ESTIMATES, EstimateJob

OPTIONS = EstimateOptions(k=6, read_length=50)


def tables(spark, genes=6, seed=1, n=8):
    """counts, positions and transcripts of random genes: some keys without a place, some transcripts without a key."""
    r = random.Random(seed)
    counts, positions, tx = [], [], []
    for g in range(genes):
        tx += [(f"g{g}", t, f"g{g}.{t}", "ACGT" * 10) for t in range(n)]
        for k in range(r.randint(0, 25)):
            counts.append((f"g{g}", f"k{k}", r.choice([0, 0, 3, 50, 700])))
            for t in r.sample(range(n - 1), r.choice([0, 1, 2, 5])):
                positions += [(f"g{g}", f"k{k}", t, p) for p in range(r.randint(1, 3))]
    return (
        spark.createDataFrame(counts, "gid string, key string, count long"),
        spark.createDataFrame(positions, "gid string, key string, tidx int, position int"),
        spark.createDataFrame(tx, "gid string, tidx int, tid string, seq string"),
    )


def by_place(df):
    return {(r.gid, r.tidx): (r.n_reads_kmers, r.density, r.share) for r in df.collect()}


def test_classes_hold_what_they_touch(spark):
    counts, positions, tx = tables(spark)
    classes = estimate.weight_classes(counts, positions, tx)
    want = {}
    where = {}
    for r in positions.collect():
        where.setdefault((r.gid, r.key), {}).setdefault(r.tidx, 0)
        where[r.gid, r.key][r.tidx] += 1
    for r in counts.collect():
        entries = tuple(sorted(where.get((r.gid, r.key), {}).items()))
        total, n = want.get((r.gid, entries), (0, 0))
        want[r.gid, entries] = (total + r["count"], n + 1)
    got = {(r.gid, tuple((e.tidx, e.weight) for e in r.entries)): (r.total_counts, r.occurrences) for r in classes.collect()}
    assert got == want and {r.n for r in classes.collect()} == {8}


@pytest.mark.parametrize("rounds", [1, 4, None])
def test_rounds_of_aggregations_equal_groups(spark, rounds):
    classes = estimate.weight_classes(*tables(spark, 4))
    options = replace(OPTIONS, tolerance=1e-3)
    whole = estimate.estimate_genes(classes, options, rounds)
    apart = estimate.estimate_genes(classes, replace(options, group_entries=12), rounds)
    a, b = by_place(whole), by_place(apart)
    assert a.keys() == b.keys() and len(a) > 0
    for place, values in a.items():
        assert b[place] == pytest.approx(values, abs=1e-6)
    assert {(r.gid, r.rounds) for r in whole.collect()} == {(r.gid, r.rounds) for r in apart.collect()}


def test_rounds_begin_from_shares(spark):
    classes = estimate.weight_classes(*tables(spark, 3))
    first = estimate.estimate_genes(classes, OPTIONS, 2).select("gid", "tidx", "share")
    a = by_place(estimate.estimate_genes(classes, OPTIONS, 2, first))
    b = by_place(estimate.estimate_genes(classes, replace(OPTIONS, group_entries=0), 2, first))
    assert a.keys() == b.keys()
    for place in a:
        assert b[place] == pytest.approx(a[place], abs=1e-6)


def test_a_gene_of_many_transcripts(spark):
    """20,000 transcripts, each with a key of its own and one that all share: a matrix would have 4 * 10**8 cells."""
    n = 20_000
    own = spark.range(n).select(F.lit("g").alias("gid"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("int").alias("tidx"), F.lit(0).alias("position"))
    shared = own.withColumn("key", F.lit("all"))
    counts = own.select("gid", "key", (F.col("tidx") % 7).cast("long").alias("count")).unionByName(spark.createDataFrame([("g", "all", 1000)], "gid string, key string, count long"))
    tx = own.select("gid", "tidx")
    classes = estimate.weight_classes(counts, own.unionByName(shared), tx)
    sums = estimate.estimate_genes(classes, OPTIONS, 3).agg(F.count("*").alias("n"), F.sum("n_reads_kmers").alias("s")).first()
    assert (sums.n, round(sums.s, 3)) == (n, sum(i % 7 for i in range(n)) + 1000)


def test_coverage_equals_a_loop(spark):
    counts, positions, tx = tables(spark, 5, 3)
    classes = estimate.weight_classes(counts, positions, tx)
    touched = {}
    for r in classes.collect():
        for e in r.entries:
            touched.setdefault((r.gid, e.tidx), set()).add(r["class"])
    want = {(f"g{g}", a, b) for g in range(5) for a in range(8) for b in range(8) if a != b and touched.get((f"g{g}", b), set()) <= touched.get((f"g{g}", a), set())}
    assert {tuple(r) for r in estimate.covered_transcripts(classes, tx).collect()} == want


def test_coverage_of_more_classes_than_a_number_has_bits(spark):
    n = 150
    entries = [(k, t) for k in range(n) for t in ([0, 1] if k < 140 else [0])] + [(0, 2), (149, 2)]
    positions = spark.createDataFrame([("g", f"k{k}", t, p) for k, t in entries for p in range(1 + k)], "gid string, key string, tidx int, position int")
    counts = spark.createDataFrame([("g", f"k{k}", 1) for k in range(n)], "gid string, key string, count long")
    tx = spark.createDataFrame([("g", t) for t in range(3)], "gid string, tidx int")
    got = estimate.covered_transcripts(estimate.weight_classes(counts, positions, tx), tx)
    assert {tuple(r) for r in got.collect()} == {("g", 0, 1), ("g", 0, 2)}


def stream_tables(spark):
    seqs = {g: "".join(random.Random(g).choice("ACGT") for _ in range(120)) for g in "ab"}
    tx = spark.createDataFrame([(g, t, f"{g}{t}", s[: 90 + 30 * t]) for g, s in seqs.items() for t in range(2)], "gid string, tidx int, tid string, seq string")
    regions = index.signature_regions(tx, 6)
    keys = select.selected_keys(regions, 6, 10)
    return seqs, tx, keys, select.key_positions(regions, keys, 6, 1)


def test_state_survives_a_restart_and_looks_at_touched_genes_only(spark, tmp_path):
    seqs, tx, keys, positions = stream_tables(spark)
    place = str(tmp_path / "in")
    arrivals = [[seqs["a"][i : i + 50] for i in range(60)] + [seqs["b"][:50]], [seqs["b"][i : i + 50] for i in range(70)]]
    rows = {}
    for i, part in enumerate(arrivals):
        spark.createDataFrame([(x,) for x in part], "seq string").repartition(2).write.mode("append").parquet(place)
        reads = spark.readStream.schema("seq string").parquet(place)
        job = EstimateJob(reads, keys, positions, tx, OPTIONS, interval=None, folder=str(tmp_path / "job"), rounds=3)
        job.finish()
        rows[i] = by_place(job.estimates)
    assert all(rows[0][p] == rows[1][p] for p in rows[0] if p[0] == "a") and any(rows[0][p] != rows[1][p] for p in rows[0] if p[0] == "b")
    written = spark.read.parquet(str(tmp_path / "job" / "rows"))
    assert {(r.batch, r.gid) for r in written.select("batch", "gid").distinct().collect()} == {(0, "a"), (0, "b"), (1, "b")}
    # the counts are those of all reads, so an estimate from the same shares is the same
    first = spark.createDataFrame([(g, t, s) for (g, t), (_, _, s) in rows[0].items()], "gid string, tidx int, share double")
    classes = estimate.weight_classes(count.key_counts(keys, spark.read.parquet(place), 6), positions, tx)
    batch = by_place(estimate.estimate_genes(classes, OPTIONS, 3, first))
    for p in rows[1]:
        if p[0] == "b":
            assert rows[1][p] == pytest.approx(batch[p], abs=1e-9)


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"{ESTIMATES}, line string")
    row = lambda x: spark.createDataFrame([("g", 0, x, x, 1.0, 1, f"t\t{x}")], schema).first()
    path, report = str(tmp_path / "rows"), str(tmp_path / "report")
    for batch, values in ((0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, []), (2, [5.0])):
        writer = BatchWriter(path, report, schema)
        abandoned = BatchWriter(path, report, schema).write(iter([row(9.0)]))
        messages = [writer.write(iter([row(x)])) for x in values] + [None, BatchWriter(path, report, schema).write(iter([]))]
        assert abandoned.name and messages[-1] == Staged(None)
        BatchWriter(path, report, schema).commit(messages, batch)
    assert sorted((r.batch, r.density) for r in spark.read.parquet(path).collect()) == [(0, 1.0), (0, 2.0), (2, 5.0)]
    assert sorted(r.value for r in spark.read.text(report).collect()) == ["t\t1.0", "t\t2.0", "t\t5.0"]
    assert [r.density for r in latest(spark, path, ["gid", "tidx"], ESTIMATES).collect()] == [5.0]
    assert latest(spark, str(tmp_path / "none"), ["gid", "tidx"], ESTIMATES).collect() == []


def test_sparse_rounds_equal_a_matrix():
    r = np.random.default_rng(2)
    w = r.integers(0, 3, (12, 5)).astype(float) * (r.random((12, 5)) < 0.5)
    c, o = r.integers(0, 50, 12).astype(float), r.integers(1, 5, 12).astype(float)
    pi, size = np.full(5, 0.2), o @ w
    for _ in range(4):
        part = np.divide(w * o[:, None], size, out=np.zeros(w.shape), where=size > 0) * pi
        part = np.divide(part, part.sum(1, keepdims=True), out=np.zeros_like(part), where=part.sum(1, keepdims=True) > 0)
        found = c @ part
        pi = found / found.sum()
    density, _, done = estimate.expectation_maximisation(w, c, o, rounds=4)
    assert done == 4 and density * size == pytest.approx(found)
