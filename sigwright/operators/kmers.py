"""k-mer tables: of oriented transcripts and of reads.

Transcripts are rows (gid, tidx, tid, seq); tidx counts from 0 within a gene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.functions import dna
from sigwright.operators import packed


def exploded(rows: DataFrame, k: int, *keep: str, seq: str = "seq", include_last: bool = False) -> DataFrame:
    """keep columns, pos and kmer of the windows of seq; sequences that are too short, or null, give none.

    Positions are exploded, not arrays of k-mers: both steps stay in generated code, and a row's sequence is
    cut in place.
    """
    last = F.char_length(seq) - k + (1 if include_last else 0)
    each = rows.filter(last >= 1).select(*keep, F.col(seq).alias("__seq"), F.explode(F.sequence(F.lit(0), last - 1)).alias("pos"))
    return each.select(*keep, "pos", F.substr("__seq", F.col("pos") + 1, F.lit(k)).alias("kmer"))


def windows(transcripts: DataFrame, k: int, include_last: bool = False) -> DataFrame:
    """(gid, tidx, pos, kmer) of the forward windows."""
    return exploded(transcripts, k, "gid", "tidx", include_last=include_last)


def gene_kmers(transcripts: DataFrame, k: int) -> DataFrame:
    """Distinct (gid, kmer) over all four orientations. Each orientation leaves out its own last window, so the
    set is not closed under them at the ends of sequences. k-mers travel packed, as far as they can."""
    if k > packed.LONGEST:
        return plain_gene_kmers(transcripts, k)
    return packed.distinct(transcripts, k).unionByName(plain_gene_kmers(transcripts.filter(packed.other()), k).filter(packed.other("kmer")))


def plain_gene_kmers(transcripts: DataFrame, k: int) -> DataFrame:
    """The same, as strings."""
    oriented = transcripts.select("gid", F.explode(dna.orientations(F.col("seq"))).alias("seq"))
    return exploded(oriented, k, "gid").select("gid", "kmer").distinct()


def read_kmers(reads: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep ..., kmer) of all windows of reads, the last included, but for those with an N."""
    return exploded(reads, k, *keep, seq=seq, include_last=True).select(*keep, "kmer").filter(~F.col("kmer").contains("N"))
