import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigwright.functions import bloom, dna

import model


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_orientations(spark):
    assert column(spark, ["AACG", "ACGT", "", None, "acgN"], dna.orientations) == [*map(model.four, ["AACG", "ACGT", ""]), [None] * 4, ["acgN", "Ngca", "Ngca", "acgN"]]
    assert column(spark, ["TTGC"], dna.canonical) == [min(model.four("TTGC"))]


def test_split_record(spark):
    cases = {"a|b": ["a", "b"], "a|": ["a"], "a||b": ["a", "", "b"], "": [], "|": [""], "a\nb": ["a", "b"], "a||": ["a", ""], "a|\n": ["a", ""], "x": ["x"]}
    assert column(spark, cases, dna.split_record) == list(cases.values())


def reference_samples(seq, k, n):
    step = ((len(seq) - 2 * k) % 2**64 // (n - 1)) % 2**32
    step = step - 2**32 if step >= 2**31 else step
    out, start = [], k // 2 + 1
    for _ in range(n):
        if start <= len(seq):
            out.append(seq[start : start + k])
            start += max(0, step)
    return out


@pytest.mark.parametrize("k,n", [(1, 3), (2, 3), (7, 3), (12, 20), (5, 20), (40, 20)])
def test_even_samples(spark, k, n):
    seqs = ["ABAAABAAABA", *("ACGTTGCAAC"[i % 7 :] * 12 for i in range(3)), *("ACGGTCATTA" * 10)[:100][:0:-9], "A" * 31, ""]
    seqs = [s[:m] for s in seqs for m in (0, 3, k // 2, k // 2 + 1, k // 2 + 2, 2 * k - 1, 2 * k, 2 * k + 18, 2 * k + 19, 120)]
    assert column(spark, seqs, lambda c: dna.even_samples(c, k, n)) == [reference_samples(s, k, n) for s in seqs]


def test_windows_of_short_sequences(spark):
    got = column(spark, ["ACG", "ACGT", "ACGTA", None, ""], lambda c: dna.kmers(c, 4))
    assert [[w.kmer for w in x] for x in got] == [[], [], ["ACGT"], [], []]
    got = column(spark, ["ACG", "ACGT", "ACGTA"], lambda c: dna.kmers(c, 4, include_last=True))
    assert [[(w.pos, w.kmer) for w in x] for x in got] == [[], [(0, "ACGT")], [(0, "ACGT"), (1, "CGTA")]]


def test_stride_and_offsets(spark):
    lengths = [1, 19, 20, 29, 128, 700, 5000]
    for m in (3, 10, 14, 25):
        want = [max(10, min(50 + (10 - m) * 10, int((n - 20) / m))) for n in lengths]
        assert column(spark, lengths, lambda c, m=m: dna.stride(c, m), "int") == want
    assert column(spark, [20, 21, 31, 45], lambda c: dna.region_offsets(c, F.lit(10)), "int") == [[], [20], [20, 30], [20, 30, 40]]


def test_positions_and_views(spark):
    assert column(spark, ["AAAA", "CACA", "", "A"], lambda c: dna.all_positions(c, F.lit("AA"))) == [[0, 1, 2], [], [], []]
    words = ["abcab", "b", "", "zz"]
    assert column(spark, words, lambda c: dna.last_index(c, F.lit("ab"))) == [w.rfind("ab") for w in words]


def test_jaccard_of_arrays(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert sorted(r.j for r in df.select(dna.jaccard(F.col("a"), F.col("b")).alias("j")).collect()) == [0, pytest.approx(1 / 3), 1]


def test_float_range(spark):
    for start, stop, step in ((0, 1, 0.25), (0.5, 2, 0.4), (1, 1, 0.1), (2, 1, 0.5)):
        want, x = [], start
        while x < stop:
            want.append(x)
            x += step
        assert column(spark, ["x"], lambda c, a=(start, stop, step): dna.float_range(*a))[0] == pytest.approx(want)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGTN", min_size=8, max_size=8), min_size=1, max_size=20))
def test_rolled_hash_is_a_fresh_hash(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "x string")
    fresh = dna.polynomial_hash(F.substr("x", F.lit(2), F.lit(7)))
    rolled = dna.polynomial_roll(dna.polynomial_hash(F.substr("x", F.lit(1), F.lit(7))), 7, F.substr("x", F.lit(8), F.lit(1)), F.substr("x", F.lit(1), F.lit(1)))
    for r in df.select("x", fresh.alias("a"), rolled.alias("b")).collect():
        h = 0
        for ch in r.x[1:]:
            h = (33 * h + ord(ch)) % 2**32
        assert r.a == r.b == h


def test_bloom_sizes_and_filter(spark):
    row = spark.range(1).select(bloom.bytes_for(F.lit(1000), F.lit(0.001)).alias("n")).first()
    assert row.n == math.ceil(math.ceil(1000 * 14.377587) / 8)
    assert spark.range(1).select(bloom.hashes_for(F.lit(row.n), F.lit(1000)).alias("k")).first().k == 10
    assert spark.range(1).select(bloom.bytes_for(F.lit(0), F.lit(0.1)).alias("n")).first().n is None
    filled = bloom.MemberFilter(spark.range(1000).selectExpr("cast(id as string) x"), "x", 1000)
    assert all(filled.contains(str(i)) for i in range(1000)) and sum(filled.contains(f"n{i}") for i in range(1000)) < 20
    assert filled.add("new") and not filled.add("new")


def test_scaling_without_reads(spark):
    got = spark.range(1).select(dna.rpkm(F.lit(0.0), F.lit(100), F.lit(0.0)).alias("r"), dna.tpm(F.lit(0.0), F.lit(100), F.lit(0.0)).alias("t")).first()
    assert tuple(got) == (0, 0)


def test_attributes_by_their_exact_names(spark):
    texts = {
        'ref_gene_id "X"; gene_id "Y";': "Y",
        'gene_id "a b;c"; other "1"': "a b;c",
        'note "x; gene_id "; gene_id "Z";': "Z",
        'gene_id 5; gene_id "later"': None,
        'gene_id "";': None,
        'exon_number 3; gene_id "G"': "G",
        'gene_id  "T";gene_name "n"': "T",
        "": None,
        'gene_idx "Q"; xgene_id "R"': None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "extra string")
    got = {r.extra: r.v for r in df.select("extra", dna.gtf_attribute(F.col("extra"), "gene_id").alias("v")).collect()}
    assert got == texts


def test_mean_quality(spark):
    df = spark.createDataFrame([("!",), ("I5!",), ("",), (None,)], "q string")
    assert [r[0] for r in df.coalesce(1).select(dna.mean_quality(F.col("q"))).collect()] == [0.0, (40 + 20 + 0) / 3, None, None]
