"""Which k-mers belong to one gene only, and the maximal regions they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.functions import dna
from sigwright.operators import packed
from sigwright.operators.kmers import exploded, plain_gene_kmers, windows
from sigwright.runtime import cut


def duplicated_kmers(transcripts: DataFrame, k: int) -> DataFrame:
    """(kmer, n_genes) of k-mers that two genes or more have in any orientation.

    One shuffle, of packed k-mers by bucket. k-mers that cannot be packed are distinct by (gene, k-mer) before they are
    counted: one shuffle by both, one by k-mer of counts that were combined before.
    """
    rest = transcripts if k > packed.LONGEST else transcripts.filter(packed.other())
    plain = plain_gene_kmers(rest, k).groupBy("kmer").agg(F.count("*").alias("n_genes")).filter("n_genes >= 2")
    return plain if k > packed.LONGEST else packed.repeated(transcripts, k).unionByName(plain.filter(packed.other("kmer")))


def shared_kmers(transcripts: DataFrame, k: int) -> DataFrame:
    """(kmer) of those k-mers, as strings, without the number of genes: one shuffle, by k-mer, of the least and largest gene
    that a task has seen. Genes are compared by 64-bit hashes of their ids."""
    oriented = transcripts.select(F.xxhash64("gid").alias("gene"), F.explode(dna.orientations(F.col("seq"))).alias("seq"))
    found = exploded(oriented, k, "gene").groupBy("kmer").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))
    return found.filter("lo <> hi").select("kmer")


def signature_windows(transcripts: DataFrame, k: int, duplicated: DataFrame | None = None) -> DataFrame:
    """(gid, tidx, pos, kmer) of windows whose k-mer no other gene has.

    Packed windows meet the k-mers of all genes in their bucket. The others go by a join: duplicated k-mers are written before
    they are used, so their size is known, and where Spark's bound for broadcasts holds them, windows are not shuffled for this.
    """
    if duplicated is None and k <= packed.LONGEST:
        rest = transcripts.filter(packed.other())
        plain = windows(rest, k).filter(packed.other("kmer")).join(shared_kmers(rest, k), "kmer", "left_anti")
        return packed.signature(transcripts, k).unionByName(plain.select("gid", "tidx", "pos", "kmer"))
    duplicated = cut(shared_kmers(transcripts, k), "shared-kmers") if duplicated is None else duplicated
    return windows(transcripts, k).join(duplicated.select("kmer"), "kmer", "left_anti").select("gid", "tidx", "pos", "kmer")


def signature_regions(transcripts: DataFrame, k: int, duplicated: DataFrame | None = None) -> DataFrame:
    """(gid, tidx, tid, length, position, n_windows, seq) of maximal runs of signature windows.

    seq has n_windows + k bases: the windows and one base more, which a region inside a transcript shares with
    the window that ends it.
    A run is an island of positions; windows are ordered within one transcript, which is bounded.
    """
    found = signature_windows(transcripts, k, duplicated).select("gid", "tidx", "pos")
    in_order = Window.partitionBy("gid", "tidx").orderBy("pos")
    islands = found.withColumn("island", F.col("pos") - F.row_number().over(in_order)).groupBy("gid", "tidx", "island")
    runs = islands.agg(F.min("pos").alias("position"), F.count("*").cast("int").alias("n_windows"))
    seq = F.substr("seq", F.col("position") + 1, F.col("n_windows") + k)
    return runs.join(transcripts, ["gid", "tidx"]).select("gid", "tidx", "tid", F.char_length("seq").alias("length"), "position", "n_windows", seq.alias("seq"))
