"""Genes that share k-mers, and the clusters they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.functions import dna
from sigwright.operators import packed
from sigwright.operators.components import connected_components
from sigwright.operators.kmers import plain_gene_kmers
from sigwright.operators.ranges import prefix_sums
from sigwright.options import ClusterOptions
from sigwright.runtime import Cut


def gene_samples(transcripts: DataFrame, k: int, n: int = 20) -> DataFrame:
    """(gid, kmer) of even samples of every transcript, repeats kept."""
    return transcripts.select("gid", F.explode(dna.even_samples(F.col("seq"), k, n)).alias("kmer"))


#: Genes that own a sampled k-mer from which on it is heavy: pairs of its genes are made by classes of genes.
#: Below it, tasks join packed samples with packed k-mers and send on sums of pairs, so a k-mer may have many genes.
HEAVY = 1024
#: Rows of each side of a tile.
TILE = 1024


def tiled_join(left: DataFrame, right: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """The inner join by a key (not null) that few distinct rows may have or most. Both sides of a key are cut into blocks, and
    each block meets each of the other side: a task has one tile of rows, whatever the key's share of all."""
    per = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    blocks = per(left, "__l").join(per(right, "__r"), key)
    place = lambda rows, n: F.pmod(F.xxhash64(*(c for c in rows.columns)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(blocks, key).withColumn("__i", place(left, "__l")).withColumn("__j", every("__r")).drop("__l", "__r")
    two = right.join(blocks, key).withColumn("__j", place(right, "__r")).withColumn("__i", every("__l")).drop("__l", "__r")
    return one.join(two, [key, "__i", "__j"]).drop("__i", "__j")


def _named(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows (gid, kmer, ...) as classes of genes that have the same rows: (gid, <name>, rows array<struct<columns>>). Classes are
    named by 128 bits of hashes."""
    lists = rows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    return lists.withColumn(name, F.concat(F.hex(F.xxhash64(F.lit(1), "rows")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "rows"))))


def _sets(classes: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The rows of each class, once."""
    once = classes.groupBy(name).agg(F.any_value("rows").alias("rows")).select(name, F.explode("rows").alias("r"))
    return once.select(name, *(F.col(f"r.{c}").alias(c) for c in columns))


def _plain_overlaps(transcripts: DataFrame, k: int, n: int, heavy: int, others: bool) -> DataFrame:
    """packed.overlaps as joins of strings; others: of k-mers with other letters than A, C, G and T only."""
    among = lambda rows: rows.filter(packed.other("kmer")) if others else rows
    samples = Cut(among(gene_samples(transcripts, k, n)).groupBy("gid", "kmer").agg(F.count("*").alias("times")), "gene-samples").df
    owned = Cut(among(plain_gene_kmers(transcripts, k)).join(samples.select("kmer").distinct(), "kmer", "left_semi"), "sampled-kmers").df
    held = owned.groupBy("kmer").agg(F.count("*").alias("held"))
    many = Cut(held.filter(F.col("held") > heavy).select("kmer"), "heavy-kmers").df
    few = held.filter((F.col("held") > 1) & (F.col("held") <= heavy)).select("kmer")
    rare = samples.join(few, "kmer").join(owned.withColumnRenamed("gid", "gid2"), "kmer").filter("gid <> gid2")
    light = rare.groupBy(F.col("gid").alias("gid1"), "gid2").agg(F.sum("times").alias("n"))
    nothing = F.lit(None).cast("string")
    row = lambda rows, kind, one, two, kmer, n: rows.select(F.lit(kind).alias("kind"), one.alias("gid1"), two.alias("gid2"), kmer.alias("kmer"), n.cast("long").alias("n"))
    gid, kmer = F.col("gid"), F.col("kmer")
    pairs = row(light, packed.PAIR, F.col("gid1"), F.col("gid2"), nothing, F.col("n"))
    sampled = row(samples.join(many, "kmer"), packed.SAMPLED, gid, nothing, kmer, F.col("times"))
    return pairs.unionByName(sampled).unionByName(row(owned.join(many, "kmer"), packed.OWNER, nothing, gid, kmer, F.lit(None)))


class Overlaps:
    """What genes share of each other's samples.

    totals: (gid, total), samples of each gene. light: (gid1, gid2, dup) by k-mers that few genes own. k-mers that
    many own would make a row for each pair of their genes. Of those, genes have a vector (how often each is among
    their samples) and a set (which of them they own); genes with equal vectors, or equal sets, are a class. heavy:
    (vector, owners, dup) of pairs of classes; vectors: (gid, vector); owners: (gid, owners).
    """

    def __init__(self, transcripts: DataFrame, k: int, n: int = 20, heavy: int = HEAVY):
        transcripts = transcripts.filter("gid IS NOT NULL AND seq IS NOT NULL")
        samples = dna.even_samples(F.col("seq"), k, n)
        self.totals = transcripts.groupBy("gid").agg(F.sum(F.size(samples)).alias("total")).filter("total > 0")
        rest = transcripts if k > packed.LONGEST else transcripts.filter(packed.other())
        found = None if k > packed.LONGEST else Cut(packed.overlaps(transcripts, k, samples, heavy), "overlaps").df
        if found is None or not rest.isEmpty():
            plain = _plain_overlaps(rest, k, n, heavy, found is not None)
            found = plain if found is None else found.unionByName(plain)
        of = lambda kind: found.filter(F.col("kind") == kind)
        self.light = of(packed.PAIR).groupBy("gid1", "gid2").agg(F.sum("n").alias("dup"))
        vectors = Cut(_named(of(packed.SAMPLED).select(F.col("gid1").alias("gid"), "kmer", F.col("n").alias("times")), ["kmer", "times"], "vector"), "gene-vectors").df
        owners = Cut(_named(of(packed.OWNER).select(F.col("gid2").alias("gid"), "kmer"), ["kmer"], "owners"), "gene-owners").df
        met = tiled_join(_sets(vectors, "vector", ["kmer", "times"]), _sets(owners, "owners", ["kmer"]), "kmer")
        self.heavy = Cut(met.groupBy("vector", "owners").agg(F.sum("times").alias("dup")), "heavy-overlaps").df
        self.vectors, self.owners = vectors.select("gid", "vector"), owners.select("gid", "owners")

    def pairs(self) -> DataFrame:
        """(gid1, gid2, dup, total) of all pairs with dup >= 1; where thousands of genes share a k-mer these are
        millions of rows, made tile by tile."""
        first = tiled_join(self.heavy, self.vectors.withColumnRenamed("gid", "gid1"), "vector")
        both = tiled_join(first.select("owners", "gid1", "dup"), self.owners.withColumnRenamed("gid", "gid2"), "owners").filter("gid1 <> gid2")
        summed = self.light.unionByName(both.select("gid1", "gid2", "dup")).groupBy("gid1", "gid2").agg(F.sum("dup").alias("dup"))
        return summed.join(self.totals.withColumnRenamed("gid", "gid1"), "gid1").select("gid1", "gid2", "dup", "total")

    def links(self, threshold: float = 0.1) -> DataFrame:
        """(src, dst) that join the same genes as the edges of all pairs at the threshold, in fewer rows: where a class's
        vector alone reaches it, each of its genes is linked with all owners, and a star says as much."""
        total = self.totals.select(F.col("gid").alias("gid1"), "total")
        # genes of a class may differ in their totals by light samples: by total they are one class
        sized = self.vectors.join(self.totals, "gid")
        strong = sized.select("vector", "total").distinct().join(self.heavy, "vector").filter(F.col("dup") / F.col("total") >= threshold)
        hub = self.owners.groupBy("owners").agg(F.min("gid").alias("hub"))
        spokes = self.owners.join(strong.select("owners").distinct(), "owners", "left_semi").join(hub, "owners").select(F.col("gid").alias("src"), F.col("hub").alias("dst"))
        heads = sized.groupBy("vector", "total").agg(F.min("gid").alias("head"))
        of_class = sized.join(strong.select("vector", "total").distinct(), ["vector", "total"], "left_semi").join(heads, ["vector", "total"]).select(F.col("gid").alias("src"), F.col("head").alias("dst"))
        across = strong.join(heads, ["vector", "total"]).join(hub, "owners").select(F.col("head").alias("src"), F.col("hub").alias("dst"))
        # pairs that share light k-mers: what they share of heavy ones counts with these
        both = self.light.join(self.vectors.withColumnRenamed("gid", "gid1"), "gid1", "left").join(self.owners.withColumnRenamed("gid", "gid2"), "gid2", "left")
        both = both.join(self.heavy.withColumnRenamed("dup", "more"), ["vector", "owners"], "left").join(total, "gid1")
        more = F.coalesce("more", F.lit(0))
        # where the heavy ones alone reach the threshold, stars have joined the two already
        near = both.filter(((F.col("dup") + more) / F.col("total") >= threshold) & (more / F.col("total") < threshold)).select(F.col("gid1").alias("src"), F.col("gid2").alias("dst"))
        return near.unionByName(spokes).unionByName(of_class).unionByName(across).filter("src <> dst").distinct()


def containment(transcripts: DataFrame, k: int, n: int = 20) -> DataFrame:
    """(gid1, gid2, dup, total) of gene pairs of which gid2 has ``dup`` >= 1 of the ``total`` samples of gid1.

    An equi-join on k-mers, not a loop over pairs. Equal samples of a gene are counted before the join, and of
    gene k-mers only those that some sample has take part. k-mers of many genes: see Overlaps.
    """
    return Overlaps(transcripts, k, n).pairs()


def similarity_edges(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Undirected (src, dst), src < dst, of pairs that share the threshold or more in either direction."""
    near = pairs.filter(F.col("dup") / F.col("total") >= threshold)
    return near.select(F.least("gid1", "gid2").alias("src"), F.greatest("gid1", "gid2").alias("dst")).distinct()


def clusters(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, root) of every gene; genes: (idx, gid). root is the smallest idx that is reachable."""
    a, b = genes.select(F.col("gid").alias("src"), F.col("idx").alias("a")), genes.select(F.col("gid").alias("dst"), F.col("idx").alias("b"))
    reached = connected_components(edges.join(a, "src").join(b, "dst"), "a", "b")
    return genes.select("idx").join(reached.withColumnRenamed("node", "idx"), "idx", "left").select("idx", F.coalesce("root", "idx").alias("root"))


def merged(transcripts: DataFrame, genes: DataFrame, roots: DataFrame) -> DataFrame:
    """Transcripts of clusters: (gid, tidx, tid, seq) with the gid of the member of least idx, members in order.

    A gene's first place in its cluster is a prefix sum over genes, in ranges; sequences join it by gene. So a cluster of
    all genes is no task of its own. tidx counts from 0 without gaps.
    """
    sizes = transcripts.groupBy("gid").agg((F.max("tidx") + 1).cast("long").alias("size"))
    members = genes.join(roots, "idx").join(sizes, "gid").select("root", "idx", "gid", "size")
    placed = Cut(prefix_sums(members, [F.col("root"), F.col("idx")], {"before": F.col("size")}), "cluster-places").df
    # the first member of a cluster in the index may have no transcripts
    start = placed.groupBy("root").agg(F.min("before").alias("start"))
    heads = genes.select(F.col("idx").alias("root"), F.col("gid").alias("head"))
    first = placed.join(start, "root").join(heads, "root").select("gid", "head", (F.col("before") - F.col("start")).alias("first"))
    return transcripts.join(first, "gid").select(F.col("head").alias("gid"), (F.col("first") + F.col("tidx")).cast("int").alias("tidx"), "tid", "seq")


def cluster_transcripts(transcripts: DataFrame, genes: DataFrame, options: ClusterOptions) -> DataFrame:
    """The clustering stage: transcripts by gene in, transcripts by cluster out."""
    links = Overlaps(transcripts, options.k, options.samples).links(options.threshold)
    return merged(transcripts, genes, clusters(genes, links))
