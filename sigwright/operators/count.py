"""How often keys occur in reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigwright.functions import dna
from sigwright.operators import packed
from sigwright.operators.kmers import read_kmers
from sigwright.runtime import Cut


#: Bytes of wanted k-mers (and 64 more for each) up to which they are sent to every task.
_BROADCAST_BYTES = 32 << 20


def oriented_keys(keys: DataFrame) -> DataFrame:
    """(gid, key, kmer): every key in its four orientations, equal ones kept."""
    return keys.select("gid", "key", F.explode(dna.orientations(F.col("key"))).alias("kmer"))


def kmer_counts(reads: DataFrame, wanted: DataFrame, k: int, weight: str | None = None, seen: Observation | None = None) -> DataFrame:
    """(kmer, n) over the read k-mers that are wanted (distinct kmer rows). weight: a column of reads to sum instead of
    counting each as one. seen observes ``kmers``, all read k-mers, on the way.

    Reads are the large side. If the wanted k-mers are few (they are counted first), they are sent to every
    task and cut the reads before anything is shuffled; else counts, combined per task, meet them. Tasks count packed k-mers.
    """
    if k <= packed.LONGEST:
        few = few_kmers(wanted)
        chunks = packed.read_chunks(reads, k, weight, None if few is None else packed.Wanted(few, k))
        if seen is not None:
            chunks = chunks.observe(seen, F.coalesce(F.sum("seen"), F.lit(0)).alias("kmers"))
        counted = packed.summed(chunks, k)
        return counted if few is not None else counted.join(wanted.select("kmer"), "kmer", "left_semi")
    found, wanted = read_kmers(reads, k, keep=(weight,) if weight else ()), wanted.select("kmer")
    if seen is not None:
        found = found.observe(seen, F.count(F.lit(1)).alias("kmers"))
    total = (F.sum(weight) if weight else F.count("*")).alias("n")
    if _bytes(wanted) <= _BROADCAST_BYTES:
        return found.join(F.broadcast(wanted), "kmer", "left_semi").groupBy("kmer").agg(total)
    return found.groupBy("kmer").agg(total).join(wanted, "kmer", "left_semi")


def _bytes(wanted: DataFrame) -> int:
    return wanted.agg(F.coalesce(F.sum(F.octet_length("kmer") + 64), F.lit(0)).alias("n")).first().n


def few_kmers(wanted: DataFrame) -> list[str] | None:
    """The wanted k-mers, where they are few enough to be sent to every task."""
    return [x.kmer for x in wanted.filter("kmer IS NOT NULL").select("kmer").collect()] if _bytes(wanted) <= _BROADCAST_BYTES else None


def all_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of all read k-mers."""
    return packed.summed(packed.read_chunks(reads, k), k) if k <= packed.LONGEST else read_kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("n"))


def key_counts(keys: DataFrame, reads: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """(gid, key, count) of every key, summed over its orientations; keys that no read has count 0. weight: as in kmer_counts.

    Orientations are made of keys, not of reads. Palindromes are summed once for each equal orientation.
    """
    oriented = oriented_keys(keys)
    counted = kmer_counts(reads, oriented.select("kmer").distinct(), k, weight)
    return oriented.join(counted, "kmer", "left").groupBy("gid", "key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("count"))


def exact_counts(patterns: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of plain patterns, in the orientation given, with those that no read has at 0."""
    return patterns.select("kmer").distinct().join(kmer_counts(reads, patterns.select("kmer").distinct(), k), "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def counted_with_statistics(reads: DataFrame, wanted: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """(kmer_counts, written to the shared folder; hits; misses): read k-mers that are wanted (distinct kmer rows), and those
    that are not. All read k-mers are observed while they are counted, without a pass or a join of their own."""
    seen = Observation()
    written = Cut(kmer_counts(reads, wanted, k, seen=seen), "kmer-counts").df
    hits = written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits")).first().hits
    try:
        total = seen.get["kmers"]
    except Py4JJavaError:  # nothing is wanted: the optimizer has left out the reads, and what they would have shown
        total = read_kmers(reads, k).count()
    return written, hits, total - hits


def lookup_statistics(reads: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """One row: hits and misses, as counted_with_statistics has them."""
    _, hits, misses = counted_with_statistics(reads, wanted, k)
    return reads.sparkSession.createDataFrame([(hits, misses)], "hits long, misses long")


def both_mates(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """(read_id, mate, seq) of single or paired reads."""
    one = first.select("read_id", F.lit(1).cast("tinyint").alias("mate"), "seq")
    return one if second is None else one.unionByName(second.select("read_id", F.lit(2).cast("tinyint").alias("mate"), "seq"))
