"""From annotated exons and a genome to transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exon_rows(gtf: DataFrame, protein_coding_only: bool = True) -> DataFrame:
    """(gid, gname, tid, tname, seqname, strand, start, end, line) of exons with a gene id; end lies behind.

    gtf: rows of sources.gtf, in the order of line.
    """
    rows = gtf.filter((F.col("feature") == "exon") & F.col("gid").isNotNull())
    if protein_coding_only:
        rows = rows.filter(F.col("biotype") == "protein_coding")
    return rows.select("gid", "gname", "tid", "tname", "seqname", "strand", "start", (F.col("end") + 1).alias("end"), "line")


def mixed_strands(exons: DataFrame) -> DataFrame:
    """(gid, n_strands) of genes whose exons lie on more than one strand: an assertion on the input."""
    return exons.groupBy("gid").agg(F.count_distinct("strand").alias("n_strands")).filter("n_strands > 1")


#: Bases of a block of a chromosome.
BLOCK = 1 << 16


def in_blocks(genome: DataFrame) -> DataFrame:
    """(seqname, block, bases) of chromosomes that are rows (seqname, seq)."""
    blocks = genome.select("seqname", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.char_length("seq"), F.lit(1)) - 1) / BLOCK))).alias("block"))
    return blocks.select("seqname", "block", F.substr("seq", (F.col("block") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("bases"))


def with_sequence(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """exons with seq (null where the genome lacks the chromosome) and has_seq. The genome is in blocks of BLOCK bases,
    (seqname, block, bases), as sources.text.genome_blocks reads it, or small enough for rows (seqname, seq).

    Exons meet the blocks they lie in: no row carries a chromosome, and the genome, whose size is not bounded, is not
    broadcast. Exons beyond the end of a chromosome are cut or empty. line must name a row.
    """
    blocks = in_blocks(genome) if "seq" in genome.columns else genome
    first, last = F.col("start") - 1, F.col("end") - 2
    cover = F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))
    parts = exons.filter("start >= 1 AND end > start").select("line", "seqname", first.alias("from"), (last + 1).alias("to"), F.explode(cover).alias("block"))
    begin = F.greatest(F.col("from"), F.col("block") * BLOCK)
    piece = F.substr("bases", (begin - F.col("block") * BLOCK + 1).cast("int"), (F.least(F.col("to"), (F.col("block") + 1) * BLOCK) - begin).cast("int"))
    found = parts.join(blocks, ["seqname", "block"]).select("line", "block", piece.alias("piece")).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))
    # every chromosome has a block 0
    names = blocks.filter("block = 0").select("seqname").distinct().withColumn("has_seq", F.lit(True))
    full = exons.join(found, "line", "left").join(names, "seqname", "left").withColumn("has_seq", F.coalesce("has_seq", F.lit(False)))
    joined = F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(""))
    return full.withColumn("seq", F.when(F.col("has_seq"), joined)).select(*exons.columns, "seq", "has_seq")


def ordered_exons(exons: DataFrame) -> DataFrame:
    """exons with ord, from 0 in the direction of the strand, and offset, the bases before it in the transcript.

    On the reverse strand exons change their order; their sequence stays as it is.
    """
    place = F.when(F.col("strand") == "+", F.col("line")).otherwise(-F.col("line"))
    order = Window.partitionBy("gid", "tid").orderBy(place)
    before = F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return exons.withColumns({"ord": F.row_number().over(order) - 1, "offset": F.coalesce(before, F.lit(0)).cast("long")})


def assembled(exons: DataFrame) -> DataFrame:
    """(gid, tidx, tid, seq, has_seq): exon sequences joined in order; tidx from 0 by first line in the gene.

    Genes count as wholes even where their lines are apart, and the last one counts like the others.
    """
    exons = ordered_exons(exons)
    parts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("seq", F.lit("")).alias("seq"))))
    rows = exons.groupBy("gid", "tid").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"), F.bool_and("has_seq").alias("has_seq"), F.min("line").alias("line"))
    tidx = F.row_number().over(Window.partitionBy("gid").orderBy("line", "tid")) - 1
    return rows.select("gid", tidx.alias("tidx"), "tid", "seq", "has_seq")
