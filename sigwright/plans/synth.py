"""Sequences derived from ordinary tables, so that every operator can run on them.

dna(x) spells the MD5 digest of x with four letters, 32 bases a call. Transcripts come from part: a stretch
shared by a brand, one shared by a gene, two of its own. Reads come from lineitem, exons from part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.functions.dna import reverse_complement
from sigwright.runtime import shuffle_partitions, table

K = 12
KEYS_PER_REGION = 10
READ = 60


def dna(x: Column) -> Column:
    return F.translate(F.md5(x.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def gene_id() -> Column:
    return F.concat("p_name", F.lit("#"), "p_brand")


def sequence() -> Column:
    own = [dna(F.concat(F.lit(mark), F.col("p_partkey"))) for mark in "pq"]
    return F.concat(dna(F.col("p_brand")), dna(F.concat(F.lit("g"), gene_id())), *own)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, tidx, tid, seq)."""
    part = table(spark, sf_dir, "part")
    tidx = F.row_number().over(Window.partitionBy("gid").orderBy("p_partkey")) - 1
    rows = part.select(gene_id().alias("gid"), "p_partkey", F.concat(F.lit("T"), "p_partkey").alias("tid"), sequence().alias("seq"))
    return rows.select("gid", tidx.alias("tidx"), "tid", "seq")


def _read(start: Column) -> Column:
    return F.substr(F.col("seq"), (1 + F.pmod(start, F.char_length("seq") - READ + 1)).cast("int"), F.lit(READ))


def first_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): a window of the part's transcript; every seventh line has an N in it."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("seq"))
    rows = lines.select("l_orderkey", "l_partkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    seq = _read(F.col("l_orderkey"))
    broken = F.concat(F.substr(seq, F.lit(1), F.lit(29)), F.lit("N"), F.substr(seq, F.lit(31)))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.when(F.col("l_linenumber") == 7, broken).otherwise(seq).alias("seq"))


def second_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): the reverse complement of another window."""
    part = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("seq"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), reverse_complement(_read(F.col("l_suppkey") + F.col("l_orderkey"))).alias("seq"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqname, seq): chromosomes 1 and 2 from nation, 8 digests a row."""
    pieces = F.concat(*(dna(F.concat(F.lit(f"n{i}-"), "n_nationkey")) for i in range(8)))
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 3 + 1).alias("c"), "n_nationkey", pieces.alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "s"))), lambda x: x["s"]), "")
    return rows.filter("c < 3").groupBy("c").agg(joined.alias("seq")).select(F.col("c").cast("string").alias("seqname"), "seq")


def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): three rows for each part, of which one in four is a CDS; some lack names or a gene.
    A megabyte of part is 200,000 rows, or as many tasks' work: they are dealt out before lines are made of them."""
    part = table(spark, sf_dir, "part").repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))
    rows = part.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("e"))
    start = F.pmod(F.col("p_partkey") * 37 + F.col("e") * 101, F.lit(1900)) + 1
    end = start + F.col("p_size") % 40 + 9
    gene = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit('gene_id "'), gene_id(), F.lit('"; ')))
    name = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit('gene_name "'), F.col("p_name"), F.lit('"; ')))
    kind = F.when(F.col("p_partkey") % 7 == 0, "pseudogene").otherwise("protein_coding")
    # a name that ends like another, and a value that looks like an attribute
    other = F.when(F.col("p_partkey") % 17 == 0, 'ref_gene_id "R1"; note "x; gene_id "; ').otherwise("")
    extra = F.concat(other, gene, name, F.lit('transcript_id "T'), "p_partkey", F.lit('"; gene_biotype "'), kind, F.lit('";'))
    chromosome = F.when(F.col("p_partkey") % 13 == 0, "GL1").otherwise((F.char_length(gene_id()) % 3 + 1).cast("string"))
    strand = F.when(F.char_length(gene_id()) % 2 == 0, "+").otherwise("-")
    feature = F.when((F.col("p_partkey") + F.col("e")) % 4 == 0, "CDS").otherwise("exon")
    value = F.concat_ws("\t", chromosome, F.lit("synth"), feature, start.cast("string"), end.cast("string"), F.lit("."), strand, F.lit("."), extra)
    return rows.select((F.col("p_partkey") * 3 + F.col("e")).alias("line"), value.alias("value"))
