"""Packed k-mers against plain Python, on letters, lengths and k at the edges."""

import random

import pytest

from sigwright.operators import count, index, kmers, packed
from sigwright.plans import catalog

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rows_of(seed, alphabet="ACGT", n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        letters = alphabet if i % 5 == 0 else "ACGT"
        rows.append((f"g{i % 7}", i // 7, f"T{i}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))))
    return [*rows, ("g0", 90, "T90", None), ("g1", 91, "T91", "ACGTACGTACGTACG"), ("g2", 92, "T92", "ACGTACGTACGTACG"), (None, 0, "T93", "GGGCCCAAATTT")]


def owned(rows, k):
    out = set()
    for gid, _, _, seq in rows:
        for s in (seq, seq[::-1], seq[::-1].translate(COMPLEMENT), seq.translate(COMPLEMENT)) if seq else ():
            out |= {(gid, s[i : i + k]) for i in range(len(s) - k)}
    return out


@pytest.mark.parametrize(("k", "alphabet"), [(3, "ACGT"), (4, "ACGTNacé"), (17, "ACGTN"), (33, "ACGT")])
def test_genes(spark, k, alphabet):
    rows = rows_of(k, alphabet)
    df = spark.createDataFrame(rows, "gid string, tidx int, tid string, seq string")
    own = owned(rows, k)
    assert sorted(map(tuple, kmers.gene_kmers(df, k).collect()), key=str) == sorted(own, key=str)
    held = {}
    for gid, kmer in own:
        held.setdefault(kmer, set()).add(gid)
    assert {tuple(r) for r in index.duplicated_kmers(df, k).collect()} == {(x, len(g)) for x, g in held.items() if len(g) > 1}
    want = [(g, t, i, s[i : i + k]) for g, t, _, s in rows if s for i in range(len(s) - k) if len(held[s[i : i + k]]) == 1]
    assert sorted(map(tuple, index.signature_windows(df, k).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("k", [3, 12, 15, 31, 40])
def test_reads(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTNaé" if i % 4 == 0 else "ACGTN" if i % 4 == 1 else "ACGT") for _ in range(rng.randint(0, 60))) for i in range(80)] * 2 + [None, ""]
    df = spark.createDataFrame([(s, i % 5) for i, s in enumerate(seqs)], "seq string, weight int")
    plain, weighed = {}, {}
    for i, s in enumerate(seqs):
        for j in range(len(s or "") - k + 1):
            if "N" not in s[j : j + k]:
                plain[s[j : j + k]] = plain.get(s[j : j + k], 0) + 1
                weighed[s[j : j + k]] = weighed.get(s[j : j + k], 0) + i % 5
    assert {tuple(r) for r in count.all_counts(df, k).collect()} == set(plain.items())
    some = sorted(plain)[::3]
    wanted = spark.createDataFrame([(x,) for x in [*some, "absent"]], "kmer string")
    assert {tuple(r) for r in count.kmer_counts(df, wanted, k).collect()} == {(x, plain[x]) for x in some}
    assert {tuple(r) for r in count.kmer_counts(df, wanted, k, weight="weight").collect()} == {(x, weighed[x]) for x in some}


@pytest.mark.parametrize("k", [5, 33])
def test_statistics_without_keys(spark, k):
    reads = spark.createDataFrame([("ACGT" * 10,), ("ACNGT" * 10,)], "seq string")
    nothing = spark.createDataFrame([], "kmer string")
    whole = kmers.read_kmers(reads, k).count()
    assert tuple(count.lookup_statistics(reads, nothing, k).first()) == (0, whole)


@pytest.mark.parametrize("k", [5, 15])
def test_many_windows_in_one_task(spark, k, monkeypatch):
    """Tallies that are merged, filled and given on early."""
    rng = random.Random(k)
    import pyarrow as pa

    monkeypatch.setattr(packed, "SPAN", 50)
    seqs = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(50)]
    tally, sums = packed.Tally(k, int), {}
    for s in seqs:
        for *_, code in packed.windows(pa.array([s]), k):
            if tally.add(code, None):
                for x, n in zip(*tally.out(), strict=True):
                    sums[int(x)] = sums.get(int(x), 0) + int(n)
    for x, n in zip(*tally.out(), strict=True):
        sums[int(x)] = sums.get(int(x), 0) + int(n)
    want = {}
    for s in seqs:
        for i in range(40 - k + 1):
            code = int(packed.numbers([s[i : i + k]], k)[0])
            want[code] = want.get(code, 0) + 1
    assert sums == want


def test_profile_of_a_stream_without_keys(spark, tmp_path):
    """Keys of one short transcript: none, so no batch has a line."""
    spark.createDataFrame([(0, "a", "b", "t", 1, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").filter("p_partkey > 0").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 0, 0, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.online_profile(spark, str(tmp_path)).collect() == []


def test_even_sample_has_short_sequences_too(spark, small):
    lengths = {r.n for r in catalog.even_sample(spark, small).select("n").distinct().collect()}
    assert max(lengths) == 128 and min(lengths) < 24


def test_hits_of_a_stream_are_counted_packed(spark, monkeypatch):
    from collections import Counter

    from sigwright.streaming import counts

    reads = spark.createDataFrame([("ACGTACGTNACGA",), ("acgTACGT",), (None,), ("",), ("ACG",), ("ACGT" * 50,)], "seq string").repartition(3)
    targets = spark.createDataFrame([("ACGT", "g", "c"), ("ACGT", "g", "c"), ("TACG", "g", "d"), ("gTAC", "h", "c"), ("AAAA", "h", "d")], "kmer string, gid string, class string")
    kmers = [s[i : i + 4] for (s,) in reads.collect() if s for i in range(len(s) - 3) if "N" not in s[i : i + 4]]
    expected = Counter()
    for x, gid, name in map(tuple, targets.collect()):
        expected[gid, name] += kmers.count(x)
    for few in (counts.few_kmers, lambda _: None):
        monkeypatch.setattr(counts, "few_kmers", few)
        hits, got = counts.key_hits(reads, targets, 4), Counter()
        for r in hits.collect():
            got[r.gid, r["class"]] += r.n
        assert +got == +expected
        # no row for each window
        assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString()
