import gzip
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigwright.functions import dna
from sigwright.operators import prepare
from sigwright.sources import framed, store, text
from sigwright.streaming.counts import CountJob, EstimateJob
from sigwright.operators import count, estimate, index, select
from sigwright.options import EstimateOptions


def test_gene_records_round_trip(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">G1|T1|T2\nATTA|GAGA\n>G2|T3\nTTAA\n>G3|T4\nAC\n")
    tx = text.transcripts(text.genes(spark, str(path)))
    rows = sorted(map(tuple, tx.collect()))
    assert rows == [("G1", 0, "T1", "ATTA"), ("G1", 1, "T2", "GAGA"), ("G2", 0, "T3", "TTAA")]
    text.write_genes(tx, str(tmp_path / "out"))
    again = text.transcripts(text.genes(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, again.collect())) == rows
    text.write_transcripts(tx, str(tmp_path / "tx"))
    assert {r.header for r in text.fasta(spark, str(tmp_path / "tx")).collect()} == {"T1", "T2", "T3"}


def test_records_with_missing_sequences_raise(spark, tmp_path):
    (tmp_path / "bad.fa").write_text(">G1|T1|T2\nATTA\n")
    with pytest.raises(Exception, match="differ in number"):
        text.genes(spark, str(tmp_path / "bad.fa")).collect()


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_pieces_of_gene_files_equal_whole_records(spark, tmp_path, size):
    r = random.Random(size)
    word = lambda: "".join(r.choice("ACGTé") for _ in range(r.choice([0, 1, 2, 5, 40])))
    for f in range(4):
        records = []
        for g in range(r.choice([0, 1, 8])):
            ids, seqs = zip(*[(f"t{i}" * r.randint(0, 3), word()) for i in range(r.choice([1, 2, 3, 50]))], strict=True)
            lines = "|".join([f"g{g % 7}", *ids]), "|".join(seqs)
            # the last empty one of a line does not count
            lines = [x + "|" * (i == 0 and x.endswith("|") or (y == "" and len(ids) == 1)) for i, (x, y) in enumerate(zip(lines, (ids[-1], seqs[-1]), strict=True))]
            lines[1] += "|" * (len(ids) > 1 and seqs[-1] == "")
            records.append(">" + r.choice(["", "", " "]) + lines[0] + r.choice(["\n", "\r\n", " \t"]) + lines[1] + r.choice(["\n", "", "\n\n", " more|of it\n"]))
        (tmp_path / f"{f}.fa").write_text("".join([*records, ">G|T\nAC\n", r.choice([">H|T|U\nAC|G", ">H|T|U\nAC|G|\n|"])]))
    whole = sorted(map(str, text.transcripts(text.genes(spark, str(tmp_path))).collect()))
    before = {x: spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for x in before:
            spark.conf.set(x, str(size))
        assert sorted(map(str, text.gene_transcripts(spark, str(tmp_path)).collect())) == whole and len(whole) >= 8
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)


@pytest.mark.parametrize("record", [">G1|T1|T2\nATTA\n", ">G1\nATTA\n", ">G1|T1\nATT|A\n"])
def test_pieces_of_records_with_missing_sequences_raise(spark, tmp_path, record):
    (tmp_path / "bad.fa").write_text(record)
    with pytest.raises(Exception, match="differ in number: G1"):
        text.gene_transcripts(spark, str(tmp_path / "bad.fa")).collect()


def test_no_row_holds_a_record_that_is_written_or_read(spark, tmp_path):
    """A gene of 5,000 transcripts among genes with one, two or none to show: rows on the way have PIECE of them at most."""
    rows = [("big", i, f"T{i}", "ACGT" * 8) for i in range(5000)] + [("a", 0, "x", "ACG"), ("b", 1, "z", ""), ("b", 0, "y", "ACGT"), ("c", 0, None, "ACGTT"), (None, 0, "n", "GGGG"), ("d", 70, "p", "AC"), ("d", 3, None, None), ("e", 0, None, None)]
    tx = spark.createDataFrame(rows, "gid string, tidx int, tid string, seq string")
    assert text._in_order(tx).agg(F.max(F.char_length("text"))).first()[0] == 33 * text.PIECE - 1

    def line(gid, at):
        return "|".join(r[at] for r in sorted((r for r in rows if r[0] == gid), key=lambda r: r[1]) if r[at] is not None)

    want = {g: ">" + ("" if g is None else f"{g}|") + f"{line(g, 2)}\n{line(g, 3)}" for g in {r[0] for r in rows}}
    assert dict(map(tuple, text.gene_records(tx).collect())) == want
    text.write_genes(tx, str(tmp_path / "out"))
    files = [p.read_text() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert all(x.endswith("\n|") for x in files) and sorted("".join(x[:-1] for x in files)) == sorted("".join(x + "\n" for x in want.values()))
    pieces = spark.read.option("lineSep", "|").text(str(tmp_path / "out"))
    assert pieces.agg(F.max(F.char_length("value"))).first()[0] < 100
    text.write_genes(tx.filter("gid IN ('big', 'a', 'd')").filter("tid IS NOT NULL"), str(tmp_path / "some"))
    for got in (text.gene_transcripts(spark, str(tmp_path / "some")), text.transcripts(text.genes(spark, str(tmp_path / "some")))):
        # two bases are no record
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in ("big", "a"))


def test_reads(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\n".replace(" x", "") + "ACGT\n>r2\nGGNN\n")
    (tmp_path / "b.fq").write_text("@r1\nACGTA\n+\n@@@@@\n@r2\nTTT\n+r2\n>>>\n")
    assert sorted(tuple(r) for r in text.reads(spark, str(tmp_path / "a.fa"), [str(tmp_path / "a.fa")]).collect()) == [(1, "ACGT"), (1, "GGNN"), (2, "ACGT"), (2, "GGNN")]
    assert sorted(r.seq for r in text.reads(spark, str(tmp_path / "b.fq"), fastq=True).collect()) == ["ACGTA", "TTT"]


def test_annotation_to_transcripts(spark, tmp_path):
    line = "{c}\ts\t{f}\t{a}\t{b}\t.\t{s}\t.\tgene_id \"{g}\"; transcript_id \"{t}\"; gene_biotype \"{k}\";"
    rows = [
        "#comment",
        line.format(c="1", f="exon", a=1, b=3, s="+", g="g1", t="t1", k="protein_coding"),
        line.format(c="1", f="CDS", a=1, b=3, s="+", g="g1", t="t1", k="protein_coding"),
        line.format(c="1", f="exon", a=5, b=6, s="+", g="g1", t="t1", k="protein_coding"),
        line.format(c="2", f="exon", a=1, b=2, s="-", g="g2", t="t2", k="protein_coding"),
        line.format(c="2", f="exon", a=4, b=5, s="-", g="g2", t="t2", k="protein_coding"),
        line.format(c="9", f="exon", a=1, b=2, s="+", g="g3", t="t3", k="protein_coding"),
        line.format(c="1", f="exon", a=1, b=2, s="+", g="g4", t="t4", k="lincRNA"),
    ]
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    (tmp_path / "g.fa").write_text(">1 dna chromosome\nACG\nTTG\n>2\nCCATT\n")
    gtf = text.gtf(spark, str(tmp_path / "a.gtf.gz"))
    assert {r.gname for r in gtf.collect()} == {"g1", "g2", "g3", "g4"}
    exons = prepare.exon_rows(gtf)
    made = prepare.assembled(prepare.with_sequence(exons, text.genome(spark, str(tmp_path / "g.fa"))))
    assert sorted((r.gid, r.tid, r.seq, r.has_seq) for r in made.collect()) == [("g1", "t1", "ACGTG", True), ("g2", "t2", "TTCC", True), ("g3", "t3", "", False)]
    assert prepare.mixed_strands(exons).count() == 0
    assert prepare.exon_rows(gtf, protein_coding_only=False).count() == 6


def test_gtf_lines_are_cut_and_read_once(spark):
    import re

    extra = ['gene_id "a"; gene_idx "b"', 'xgene_id "b"; gene_id\x0b"n"; gene_id "c"', 'gene_id  x; gene_id "d"', 'note "x; gene_id "; gene_id "e"', 'note "open; gene_id "f"', 'gene_id "";', "", ";;\"gene_id \"g\"", 'gene_id   "h "; gene_id "i"', 'a"b gene_id "j"']
    lines = ["\t".join(["1", "s", "exon", "5", "x", ".", "+", ".", x + ' ; gene_biotype "protein_coding"']) for x in extra]
    lines = [*lines, "#" + lines[0], lines[0] + "\r\n", " \t", "", lines[0] + "\tmore", None]
    gtf = text.parse_gtf(spark.createDataFrame(list(enumerate(lines)), "line int, value string"))

    def named(line):
        items = re.findall(r'[^\s";]+\s+(?:"[^"]*"|[^";]*)', line.split("\t")[8])
        own = [x[len("gene_id") :].lstrip(" ") for x in items if re.split(r"\s+", x, maxsplit=1)[0] == "gene_id"]
        return own[0][1:].split('"')[0] or None if own and own[0].startswith('"') else None

    whole = [i for i in range(len(extra))] + [len(extra) + 1]
    assert {r.line: r.gid for r in gtf.collect()} == {i: named(lines[i]) for i in whole}
    assert {named(lines[i]) for i in whole} >= {"a", None, "e", "h "}
    plan = prepare.exon_rows(gtf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1


def test_assembled_genes_are_made_once_for_a_store(spark, small, monkeypatch):
    from sigwright.plans import catalog

    made, rows = spark.sparkContext.accumulator(0), catalog._assembled(spark, small).localCheckpoint()

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(catalog, "_assembled", lambda *_: rows.mapInArrow(seen, rows.schema))
    catalog.store_range(spark, small).collect()
    assert made.value == rows.count()


def test_exons_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(prepare, "BLOCK", 4)
    chromosome = "ACGTTGCAAGGCTTACC"
    places = [(1, 5), (4, 6), (3, 15), (16, 40), (30, 35), (5, 5), (1, 18), (8, 9)]
    exons = spark.createDataFrame([("c", a, b, i) for i, (a, b) in enumerate(places)] + [("d", 1, 3, 99)], "seqname string, start int, end int, line long")
    got = {r.line: (r.seq, r.has_seq) for r in prepare.with_sequence(exons, spark.createDataFrame([("c", chromosome), ("e", "")], "seqname string, seq string")).collect()}
    assert got == {i: (chromosome[a - 1 : b - 1], True) for i, (a, b) in enumerate(places)} | {99: (None, False)}


def test_overlaps_and_reports(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 3, 20)], "gid1 string, gid2 string, dup long, total long")
    text.write_overlaps(pairs, str(tmp_path / "o"))
    assert text.read_overlaps(spark, str(tmp_path / "o")).collect() == pairs.collect()
    text.write_abundance(spark.createDataFrame([("t", 100, 1.23456789, 0.0, 1e6)], "tid string, length int, est_reads double, rpkm double, tpm double"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["t\t100\t1.23457\t0\t1e+06"]
    numbers = spark.createDataFrame([(x,) for x in (0.1, 100.0, 123456.7, 1234567.0, 0.00001234567, 120.5, -2.5, 100000.0, 0.0001)], "x double")
    assert [r[0] for r in numbers.coalesce(1).select(text.significant(F.col("x"))).collect()] == ["%.6g" % x for x in (0.1, 100.0, 123456.7, 1234567.0, 0.00001234567, 120.5, -2.5, 100000.0, 0.0001)]


def test_framed_messages(spark, tmp_path):
    framed.register(spark)
    kind = framed.sql_type("SelectedKey")[7:-1]
    rows = spark.createDataFrame([("g", [("ACGT", [(0, [3, 4]), (1, [])], 7), ("TT\0T", [], None)], ["t1", "t2"], [10, 20]), ("h", [], [], [])], kind)
    framed.encoded(rows, "SelectedKey").write.format("framed").mode("append").save(str(tmp_path / "f"))
    back = framed.decoded(spark.read.format("framed").load(str(tmp_path / "f")), "SelectedKey")
    assert sorted(back.collect()) == sorted(rows.collect())
    again = framed.decoded(framed.read_binary(spark, str(tmp_path / "f")), "SelectedKey")
    assert sorted(again.collect()) == sorted(rows.collect())
    bodies = [b"abc", b"", b"\0" * 9]
    data = framed.framed(bodies)
    assert list(framed.frames(data)) == bodies and list(framed.frames(data[:-1], damaged="stop")) == bodies[:2] and list(framed.frames(data, limit=5, damaged="stop")) == bodies[:2]
    for bad in (data[:-1], data + b"\x01", data + b"\xff\xff\xff\xff"):
        with pytest.raises(framed.Damaged):
            list(framed.frames(bad))
    with pytest.raises(framed.Damaged):
        list(framed.frames(data, limit=5))


def test_framed_files_appear_when_all_tasks_are_done(spark, tmp_path):
    framed.register(spark)
    rows = framed.encoded(spark.range(40).selectExpr("concat('g', id) gid", "array() keys", "array('t') tids", "array(1) lengths").select("gid", F.expr("cast(null as " + framed.sql_type("SelectedKey") + ").keys").alias("keys"), "tids", "lengths"), "SelectedKey")
    path = str(tmp_path / "f")
    rows.repartition(5).write.format("framed").mode("append").save(path)
    names = lambda: sorted(p.name for p in (tmp_path / "f").iterdir() if not p.name.startswith("_"))
    before = names()
    assert len(before) == 5 and all(n.endswith(".framed") for n in before) and len(list((tmp_path / "f").iterdir())) == 5
    fails = F.when(F.rand(1) >= 0, F.raise_error(F.lit("no"))).cast("binary")
    with pytest.raises(Exception, match="no"):
        spark.range(8).repartition(4).select(F.when(F.col("id") == 7, fails).otherwise(F.lit(b"x")).alias("body")).write.format("framed").mode("append").save(path)
    assert names() == before
    rows.limit(3).write.format("framed").mode("overwrite").save(f"file:{path}")
    assert framed.decoded(spark.read.format("framed").load(f"file://{path}"), "SelectedKey").count() == 3
    (tmp_path / "one").write_bytes(rows.first().body)
    assert framed.decoded(framed.read_single(spark, str(tmp_path / "one")), "SelectedKey").first().tids == ["t"]
    assert framed.decoded(spark.createDataFrame([(None,)], "body binary"), "SelectedKey").first().gid is None


def test_a_damaged_file_is_no_short_result(spark, tmp_path):
    framed.register(spark)
    (tmp_path / "a.framed").write_bytes(framed.framed([b"abc", b"de"])[:-1])
    for read in (lambda: spark.read.format("framed").load(str(tmp_path)), lambda: framed.read_binary(spark, str(tmp_path))):
        with pytest.raises(Exception, match="frame"):
            read().collect()
    assert spark.read.format("framed").option("damaged", "stop").load(str(tmp_path)).count() == framed.read_binary(spark, str(tmp_path), damaged="stop").count() == 1


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    records = [f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@' * (4 * (i % 7 + 1))}" for i in range(500)]
    for n in (1, 2):
        (tmp_path / f"{n}.fq").write_text("\n".join(records[: 500 // n]) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = text.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        got = sorted((r.path[-4:], r.number, r.value) for r in lines.collect())
        seqs = sorted(r.seq for r in text.reads(spark, [str(tmp_path / "1.fq"), str(tmp_path / "2.fq")], fastq=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sorted((f"{n}.fq", i, x) for n in (1, 2) for i, x in enumerate("\n".join(records[: 500 // n]).split("\n")))
    assert seqs == sorted(x.split("\n")[1] for n in (1, 2) for x in records[: 500 // n])


def test_main_chromosomes(spark, tmp_path):
    names = ["1", "22", "X", "Y", "MT", "GL1", "", "1a", "XY", "M", "chr1", "007"]
    (tmp_path / "g").write_text("".join(f'{n}\ts\texon\t1\t2\t.\t+\t.\tgene_id "g";\n' for n in names))
    assert sorted(r.seqname for r in text.gtf(spark, str(tmp_path / "g"), main_chromosomes=True).collect()) == sorted(["1", "22", "X", "Y", "MT", "XY", "007"])


def test_store(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path / "s"))
    s.put(spark.createDataFrame([("a", 1, True), ("b", 2, False)], "gid string, v int, has_seq boolean"))
    s.put(spark.createDataFrame([("a", 3, True)], "gid string, v int, has_seq boolean"), version=1)
    assert [r.v for r in s.get("a").collect()] == [3] and s.get("z").count() == 0
    assert [r.gid for r in s.scan("a", "b").collect()] == ["a"] and [r.gid for r in s.with_sequence().collect()] == ["a"]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert store.remembered(spark, "n", 2, make, str(tmp_path / "m")).count() == store.remembered(spark, "n", 2, make, str(tmp_path / "m")).count() == 3
    assert len(made) == 1 and store.total_size(spark, str(tmp_path / "m")) > 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([("ATCGATCGA",), ("ATNCG",)], "seq string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("CGATTTATCG",)], "seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = spark.createDataFrame([("g", "ATCG"), ("g", "AAAA")], "gid string, key string")
    job = CountJob(reads, keys, 4)
    got = {r.key: r["count"] for r in job.finish().collect()}
    want = {r.key: r["count"] for r in count.key_counts(keys, spark.read.parquet(str(tmp_path / "in")), 4).collect()}
    assert got == want and job.batches == 2


def test_estimates_follow_a_stream(spark, tmp_path):
    seq = "ACGTTGCAAGGCTTACCGTAGGATCCAATGCGTACCTGAAACGTCCGATTGCAGGCATTCA"
    tx = spark.createDataFrame([("g", 0, "t", seq)], "gid string, tidx int, tid string, seq string")
    regions = index.signature_regions(tx, 6)
    keys = select.selected_keys(regions, 6, 10)
    positions = select.key_positions(regions, keys, 6)
    for i in range(2):
        spark.createDataFrame([(seq[i : i + 50],)] * 3, "seq string").write.mode("append").parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    job = EstimateJob(reads, keys, positions, tx, EstimateOptions(k=6, read_length=50), interval=None, report=str(tmp_path / "report"))
    job.finish()
    assert [r.tid for r in job.profile().collect()] == ["t"] and job.profile().first().value > 0
    assert (tmp_path / "report").is_dir() and {r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "report")).collect()} == {"t"}
    batch = estimate.estimate_genes(estimate.weight_classes(count.key_counts(keys, spark.read.parquet(str(tmp_path / "in")), 6), positions, tx), EstimateOptions(k=6, read_length=50))
    assert job.estimates.first().density == pytest.approx(batch.first().density, abs=1e-6)


def test_a_stream_that_goes_on_is_not_final(spark, tmp_path):
    (tmp_path / "in").mkdir()
    reads = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    job = CountJob(reads, spark.createDataFrame([("g", "ATCG")], "gid string, key string"), 4, interval="1 second")
    with pytest.raises(TimeoutError):
        job.finish(2)
    job.query.stop()


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    framed.register(spark)
    path, span = str(tmp_path / "f"), 1 << 20
    bodies = spark.range(4000).select(F.concat(F.repeat(F.col("id").cast("string"), 3000 + (F.col("id") % 7).cast("int")), F.lit("x")).cast("binary").alias("body"))
    bodies.coalesce(1).write.format("framed").option("span", span).mode("append").save(path)
    (file,) = (tmp_path / "f").glob("*.framed")
    assert file.stat().st_size > 40 * span
    digest = lambda df: sorted(r[0] for r in df.select(F.sha2("body", 256)).collect())
    want = digest(bodies)
    parts = spark.read.format("framed").load(path)
    assert parts.rdd.getNumPartitions() > 30 and digest(parts) == want
    most = parts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("body")).alias("n")).agg(F.max("n")).first()[0]
    assert most < 2 * span
    assert digest(framed.read_binary(spark, path)) == want
    # an index of another state of the file is not believed
    with open(file, "ab") as f:
        f.write(framed.framed([b"more"]))
    again = spark.read.format("framed").load(path)
    assert again.rdd.getNumPartitions() == 1 and again.count() == 4001
    made = framed.add_indexes(spark, path, 4 * span).collect()
    assert [r.path for r in made] == [str(file)] and 8 < made[0].parts < 14
    anew = spark.read.format("framed").load(path)
    assert anew.rdd.getNumPartitions() == made[0].parts and anew.count() == 4001
    bodies.limit(2).write.format("framed").mode("overwrite").save(path)
    assert spark.read.format("framed").load(path).count() == 2 and not list((tmp_path / "f").glob("_*.index"))


def test_single_messages_are_files(spark, tmp_path):
    framed.register(spark)
    spark.range(5).select(F.concat(F.lit("m"), "id").cast("binary").alias("body")).write.format("framed").option("single", "true").mode("append").save(str(tmp_path / "m"))
    assert len(list((tmp_path / "m").iterdir())) == 5
    assert sorted(bytes(r.body) for r in framed.read_single(spark, str(tmp_path / "m")).collect()) == [b"m0", b"m1", b"m2", b"m3", b"m4"]


def test_genome_blocks_of_files_that_are_cut_anywhere(spark, tmp_path):
    r = random.Random(8)
    dna_of = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    names = [("1", 5000), ("2", 0), ("3", 1), ("4", 777), ("5", 12_345), ("6", 64)]
    want, texts = {}, ["", "", "junk before any header\n"]
    for i, (name, n) in enumerate(names):
        seq = dna_of(n)
        want[name] = seq
        width, end = (60, 61, 1, 70, 1000, 64)[i], "\r\n" if i == 3 else "\n"
        texts[i % 3] += f">{name} dna:x{end}" + "".join(seq[k : k + width] + end for k in range(0, n, width)) + ("\n" if i == 2 else "")
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fa").write_bytes(t.encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for part, size in (("900", 100), ("150", 64), ("10000000", 5000)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        try:
            blocks = text.genome_blocks(spark, str(tmp_path), size).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        got = {(b.seqname, b.block): b.bases for b in blocks}
        assert got == {(n, k // size): s[k : k + size] for n, s in want.items() for k in range(0, max(1, len(s)), size)}


def test_exons_of_a_chromosome_in_blocks(spark, tmp_path):
    r = random.Random(9)
    seq = "".join(r.choice("ACGT") for _ in range(3 * prepare.BLOCK + 17))
    (tmp_path / "g.fa").write_text(">c x\n" + "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n>e\n")
    places = [(1, 10), (prepare.BLOCK - 5, prepare.BLOCK + 5), (100, 3 * prepare.BLOCK), (len(seq) - 3, len(seq) + 50), (len(seq) + 9, len(seq) + 12)]
    exons = spark.createDataFrame([("c", a, b, i) for i, (a, b) in enumerate(places)] + [("e", 1, 5, 90), ("no", 1, 5, 91)], "seqname string, start int, end int, line long")
    got = {x.line: (x.seq, x.has_seq) for x in prepare.with_sequence(exons, text.genome_blocks(spark, str(tmp_path / "g.fa"), prepare.BLOCK)).collect()}
    assert got == {i: (seq[a - 1 : b - 1], True) for i, (a, b) in enumerate(places)} | {90: ("", True), 91: (None, False)}


def test_qualities_weigh_reads(spark, tmp_path):
    rows = [("ACGTA", "IIIII"), ("ACGTA", "!!!!!"), ("GGGGG", "+5?I@"), ("", ""), ("TTTTT", "@+@+@")]
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{s}\r\n+\n{q}\r\n" for i, (s, q) in enumerate(rows)))
    found = text.fastq(spark, str(tmp_path / "a.fq"))
    assert sorted((r.record, r.seq, r.quality) for r in found.collect()) == [(i, s, q) for i, (s, q) in enumerate(rows)]
    good = text.weighed(found, lambda seq, quality: F.when(dna.mean_quality(quality) >= 15, 2))
    assert sorted((r.seq, r.weight) for r in good.collect()) == [("ACGTA", 2), ("GGGGG", 2), ("TTTTT", 2)]

    @F.pandas_udf("double")
    def share_of_good(quality: pd.Series) -> pd.Series:
        return quality.map(lambda q: sum(c >= "5" for c in q) / max(1, len(q)))

    weighed = text.weighed(found, lambda seq, quality: share_of_good(quality))
    keys = spark.createDataFrame([("g", "ACG"), ("g", "GGG"), ("g", "AAA")], "gid string, key string")
    got = {r.key: r["count"] for r in count.key_counts(keys, weighed, 3, weight="weight").collect()}
    # TTT is the complement of AAA; a palindrome-like run counts for each equal orientation
    plain = {r.key: r["count"] for r in count.key_counts(keys, weighed.select("seq"), 3).collect()}
    assert got["ACG"] == pytest.approx(plain["ACG"] * 1.0) and got["GGG"] == pytest.approx(plain["GGG"] * 0.8) and got["AAA"] == pytest.approx(plain["AAA"] * 0.6)


def test_lookups_are_observed_while_counting(spark, monkeypatch):
    reads = spark.createDataFrame([("ACGTACGT",), ("TTTTTT",), ("ACNGT",)], "seq string").repartition(3)
    wanted = spark.createDataFrame([("ACGT",), ("GGGG",)], "kmer string")
    for bound in (1 << 20, 0):
        monkeypatch.setattr(count, "_BROADCAST_BYTES", bound)
        counts, hits, misses = count.counted_with_statistics(reads, wanted, 4)
        assert {tuple(r) for r in counts.collect()} == {("ACGT", 2)} and (hits, misses) == (2, 6)
        assert [tuple(r) for r in count.lookup_statistics(reads.limit(0), wanted, 4).collect()] == [(0, 0)]
